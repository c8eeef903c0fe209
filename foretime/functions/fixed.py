"""Public facts and code lists that results depend on."""

# Old team codes and the code in use today.
TEAM_CODES = {
    "SD": "LAC", "SDG": "LAC",
    "STL": "LA", "LAR": "LA", "SL": "LA",
    "OAK": "LV",
    "JAC": "JAX", "ARZ": "ARI", "BLT": "BAL", "CLV": "CLE", "HST": "HOU",
    "WSH": "WAS",
}

ROOF_CLOSED = ("dome", "closed")
ROOF_OPEN = ("outdoors", "open")

IN_SEASON_ROWS = 22
SHRINK_K = 4
EWM_HALFLIFE = 5.0

# Rating fold.
RATING_K = 20.0
RATING_START = 1500.0
RATING_MARGIN_DENOM = 2.2
RATING_MARGIN_SCALE = 0.001
RATING_HOME_ADV = 44.72586959078301

# Columns that must not reach a model frame.
PRICE_COLUMNS = (
    "spread_line", "total_line", "away_moneyline", "home_moneyline", "away_spread_odds",
    "home_spread_odds", "under_odds", "over_odds", "result", "total",
)

# Venue id, latitude, longitude, zone.
VENUES = (
    ("ATL00", 33.758, -84.401, "America/New_York"),
    ("ATL97", 33.755, -84.401, "America/New_York"),
    ("BAL00", 39.278, -76.623, "America/New_York"),
    ("BOS00", 42.091, -71.264, "America/New_York"),
    ("BRG00", 30.412, -91.184, "America/Chicago"),
    ("BUF00", 42.774, -78.787, "America/New_York"),
    ("BUF01", 43.641, -79.389, "America/Toronto"),
    ("CAR00", 35.226, -80.853, "America/New_York"),
    ("CHI98", 41.862, -87.617, "America/Chicago"),
    ("CHI99", 40.100, -88.236, "America/Chicago"),
    ("CIN00", 39.095, -84.516, "America/New_York"),
    ("CLE00", 41.506, -81.700, "America/New_York"),
    ("DAL00", 32.748, -97.093, "America/Chicago"),
    ("DAL99", 32.840, -96.914, "America/Chicago"),
    ("DEN00", 39.744, -105.020, "America/Denver"),
    ("DET00", 42.340, -83.046, "America/Detroit"),
    ("FRA00", 50.068, 8.646, "Europe/Berlin"),
    ("GER00", 48.219, 11.625, "Europe/Berlin"),
    ("GNB00", 44.501, -88.062, "America/Chicago"),
    ("HOU00", 29.685, -95.411, "America/Chicago"),
    ("IND00", 39.760, -86.164, "America/Indiana/Indianapolis"),
    ("IND99", 39.766, -86.163, "America/Indiana/Indianapolis"),
    ("JAX00", 30.324, -81.638, "America/New_York"),
    ("KAN00", 39.049, -94.484, "America/Chicago"),
    ("LAX01", 33.953, -118.339, "America/Los_Angeles"),
    ("LAX97", 33.864, -118.261, "America/Los_Angeles"),
    ("LAX99", 34.014, -118.288, "America/Los_Angeles"),
    ("LON00", 51.556, -0.279, "Europe/London"),
    ("LON01", 51.456, -0.342, "Europe/London"),
    ("LON02", 51.604, -0.066, "Europe/London"),
    ("MEX00", 19.303, -99.150, "America/Mexico_City"),
    ("MIA00", 25.958, -80.239, "America/New_York"),
    ("MIN00", 44.974, -93.258, "America/Chicago"),
    ("MIN01", 44.974, -93.258, "America/Chicago"),
    ("MIN98", 44.976, -93.225, "America/Chicago"),
    ("NAS00", 36.166, -86.771, "America/Chicago"),
    ("NOR00", 29.951, -90.081, "America/Chicago"),
    ("NYC00", 40.812, -74.077, "America/New_York"),
    ("NYC01", 40.814, -74.074, "America/New_York"),
    ("OAK00", 37.752, -122.201, "America/Los_Angeles"),
    ("PHI00", 39.901, -75.168, "America/New_York"),
    ("PHI99", 39.906, -75.171, "America/New_York"),
    ("PHO00", 33.528, -112.263, "America/Phoenix"),
    ("PHO99", 33.426, -111.933, "America/Phoenix"),
    ("PIT00", 40.447, -80.016, "America/New_York"),
    ("SAN00", 29.417, -98.479, "America/Chicago"),
    ("SAO00", -23.545, -46.474, "America/Sao_Paulo"),
    ("SDG00", 32.783, -117.119, "America/Los_Angeles"),
    ("SEA00", 47.595, -122.332, "America/Los_Angeles"),
    ("SFO00", 37.713, -122.386, "America/Los_Angeles"),
    ("SFO01", 37.403, -121.970, "America/Los_Angeles"),
    ("STL00", 38.633, -90.189, "America/Chicago"),
    ("TAM00", 27.976, -82.503, "America/New_York"),
    ("VEG00", 36.091, -115.184, "America/Los_Angeles"),
    ("WAS00", 38.908, -76.864, "America/New_York"),
    ("MEL00", -37.820, 144.983, "Australia/Melbourne"),
    ("RIO00", -22.912, -43.230, "America/Sao_Paulo"),
    ("PAR00", 48.924, 2.360, "Europe/Paris"),
    ("MAD01", 40.453, -3.688, "Europe/Madrid"),
    ("MUN01", 48.219, 11.625, "Europe/Berlin"),
)

# Status texts of the line-value measurement.
LINE_MEASURED = "measured"
LINE_NO_LATER = "excluded: no pre-kickoff snapshot after the prediction snapshot"
LINE_MISSING_THEN = "excluded: missing line at prediction"
LINE_MISSING_LATE = "excluded: missing line in last pre-kickoff snapshot"
LINE_TOO_SOON = "excluded: last pre-kickoff snapshot < 6 h after the prediction snapshot"
MIN_LINE_GAP_HOURS = 6

# Decision rules.
ALPHA = 0.05
LOSS_MARGIN = 0.010
CHECKPOINT_WEEKS = (4, 9)

# Bands of the mean accuracy on shuffled labels, and the most that a fit to the real ones may reach.
SHUFFLE_EDGES = (0.45, 0.47, 0.53, 0.55)
MOST_CONTRAST = 0.70
