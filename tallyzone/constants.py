"""Fixed values.

These must equal the values of the original application for identical
results. They are stated plainly, in their natural order, and are not
derived from anything.
"""

# --- fixed values -----------------------------------------------------------

# First month for which records exist; periods before it are invalid.
EARLIEST_YEAR = 2011
EARLIEST_MONTH = 8

# Number of neighbours that vote on a missing zip code.
DEFAULT_K = 5

# Scope names; "Citywide" (or None) means no borough filter.
CITYWIDE = "Citywide"
SCOPES = ["Citywide", "The Bronx", "Manhattan", "Queens", "Brooklyn", "Staten Island"]

# Borough renamed after aggregation (exact match only).
BRONX = "Bronx"
THE_BRONX = "The Bronx"

# Columns of the persisted per-area aggregate, in this order.
AGGREGATE_COLUMNS = ["zip_code", "borough", "total_crashes"]

# Display names of the ranked table.
DISPLAY_NAMES = {
    "zip_code": "Zip Code",
    "borough": "Borough",
    "total_crashes": "Accident Count",
    "rank": "Rank",
    "crash_likelihood": "Accident Likelihood",
    "decile": "Decile",
}

# English month names, January first.
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

# Marker label of the map layer.
LABEL_FORMAT = "Zip Code: %s<br>Accidents: %s<br>Decile: %s<br>Rank: %s"

# Colour-bin edges of the map layer: nine intervals, deciles 9 and 10 share the last.
COLOUR_BIN_EDGES = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]

# Number of groups of the rank-quantile grouping.
N_GROUPS = 10

# Width of a padded zip code.
ZIP_WIDTH = 5
