"""Fixed values that results depend on."""

import math

# Crop size in pixels, gates, thresholds in metres, sphere and degree lengths.
CROP_W, CROP_H = 1024, 680
MIN_INLIERS = 7
REPROJECTION_PX = 5.0
TOP_MATCHES = 50
#: A binary descriptor matches if its first neighbour is below this share of the second's distance.
HAMMING_RATIO = 0.75
MIN_COVERAGE = 0.2
THRESHOLDS = (5, 10, 15, 20, 25, 30)
EARTH_M = 6_371_000.0
DEGREE_M = 111_320.0
#: Metres per degree of latitude in bias calibration and overlap masks; not the same as DEGREE_M on purpose.
LATITUDE_M = 110_540.0
SEARCH_FACTOR = 1.75
PRIOR_SIGMA_M = 80.0

# Footprint ratio by flight.
FOOTPRINT_K = {"01": 1.00, "02": 1.00, "03": 0.95, "04": 0.99, "05": 0.167, "06": 0.352, "08": 1.00, "10": 0.361, "11": 0.297}
#: Others: 1.75 times twice the tangent of 35 degrees.
FOOTPRINT_K_DEFAULT = 1.75 * 2 * math.tan(math.radians(35))

# Fixed values: (leg heading, yaw offset) in degrees by flight.
YAW_LEGS = {
    "01": [(166.4, -5.3), (29.2, -12.9)],
    "02": [(173.1, -2.1), (6.9, 2.5)],
    "03": [(-40.4, -1.7), (122.6, -7.0)],
    "04": [(-9.6, 1.1), (168.9, -3.8)],
    "05": [(104.7, -4.5), (-102.6, 3.9)],
    "06": [(171.1, -8.8), (-21.2, 2.9)],
    "08": [(109.1, -23.4), (-81.8, 14.2)],
    "10": [(171.9, 6.4), (-34.3, -7.6)],
    "11": [(90.3, -1.9), (-88.8, -0.5)],
}

# Appearance words cut from captions, and words that captions must not hold.
COLOR_WORDS = (
    "dark", "light", "bright", "pale", "deep", "white", "black", "grey", "gray", "green", "brown", "red", "blue", "yellow",
    "orange", "golden", "tan", "beige", "silver", "reddish", "greenish", "brownish",
)
BANNED_WORDS = (
    "satellite", "aerial", "drone", "photo", "image", "picture", "shadow", "shadows", "sunlit", "season", "seasonal",
    "lighting", "blurry", "resolution",
)
CAPTION_WORDS = (8, 20)
INLIER_EDGES = (0, 7, 15, 30, 60, 125, 250, 500, 1000)

# How colour words are cut out of captions (optional comma before, comparative endings, optional comma after, one blank instead) ...
COLOR_PATTERN = r",?\s*\b(?:{words})(?:er|est)?\b\s*,?"
COLOR_SUFFIX = "(er|est)?"
# ... and the punctuation rules after that, in this order; outer commas are stripped at the end.
TIDY_RULES = ((r"\s+,", ","), (r",\s*,", ","), (r"\s{2,}", " "), (r"\s+\.", "."))
OUTER_COMMAS = r"^,+|,+$"

# Names of job archives (job number, variant) and of result files (method).
ARCHIVE_NAME = r"^zz_(\d+)_(.+)\.tar$"
RESULT_NAME = r"visloc_(.+)_results\.csv$"

# Where a flight's map, images, frames and the maps' corners lie below the data folder.
FLIGHT_FILES = {"map": "{flight}/satellite{flight}.tif", "images": "{flight}/drone", "frames": "{flight}/{flight}.csv", "corners": "satellite_ coordinates_range.csv"}
