"""Fixed values of the domain: formats, thresholds, feature lists and name tables."""

# --- fixed values: formats -------------------------------------------------
EVENT_DATE_FORMAT = "MMM d, yyyy"
TEAM_ROW_COLUMNS = [
    "team_id", "team_name", "season", "date", "opponent", "location", "game",
    "result", "winner_score", "loser_score", "ats", "spread", "ou", "total",
]
PAGE_LOG_COLUMNS = ["date", "opponent", "game", "result", "score", "ats", "spread", "ou", "total"]
LINK_ID_PATTERN = r"/stats/gamelog/basketball/ncaab/(\d+)"
SCORE_PATTERN = r"^\s*(\d+)\s*-\s*(\d+)\s*$"
CHALLENGE_MARKERS = ["Just a moment", "cf-chl", "Enable JavaScript and cookies"]
RATINGS_PAGE_COLUMNS = [
    "rank", "TeamName", "conference", "AdjEM", "AdjOE", "oe_rank", "AdjDE", "de_rank", "AdjTempo", "tempo_rank",
]
RATING_COLUMNS = ["AdjEM", "AdjOE", "AdjDE", "AdjTempo"]
RANK_COLUMNS = ["RankAdjEM", "RankAdjOE", "RankAdjDE", "RankAdjTempo"]
RATING_RENAMES = {
    "Team": "TeamName", "Conf": "Conference", "AdjO": "AdjOE", "AdjD": "AdjDE", "AdjT": "AdjTempo",
    "Rk": "RankAdjEM", "AdjO.Rank": "RankAdjOE", "AdjD.Rank": "RankAdjDE", "AdjT.Rank": "RankAdjTempo",
}
FOUR_FACTOR_RENAMES = {
    "Team": "TeamName",
    "Off-eFG%": "off_efg", "Off-TO%": "off_to_pct", "Off-OR%": "off_or_pct", "Off-FTRate": "off_ft_rate",
    "Def-eFG%": "def_efg", "Def-TO%": "def_to_pct", "Def-OR%": "def_or_pct", "Def-FTRate": "def_ft_rate",
}
ADVANTAGE_RENAMES = {"Team": "TeamName", "HCA": "hca", "Elev": "elevation"}
HEIGHT_RENAMES = {
    "Team": "TeamName", "AvgHgt": "avg_height", "EffHgt": "eff_height",
    "Experience": "experience", "Continuity": "continuity", "Bench": "bench_pct",
}
OFFENCE_RENAMES = {
    "3P%": "off_3p_pct", "2P%": "off_2p_pct", "FT%": "off_ft_pct", "Blk%": "off_blk_pct",
    "Stl%": "off_stl_pct", "A%": "off_ast_pct", "3PA%": "off_3pa_rate",
}
DEFENCE_RENAMES = {
    "3P%": "def_3p_pct", "2P%": "def_2p_pct", "Blk%": "def_blk_pct", "Stl%": "def_stl_pct", "3PA%": "def_3pa_rate",
}
FOUR_FACTOR_COLUMNS = [
    "off_efg", "off_to_pct", "off_or_pct", "off_ft_rate", "def_efg", "def_to_pct", "def_or_pct", "def_ft_rate",
]
HEIGHT_COLUMNS = ["avg_height", "experience", "continuity", "bench_pct"]
UNMAPPED_NOTE = "NEEDS MANUAL MAPPING"
AUTO_NOTE = "auto-matched"

# --- fixed values: constants -----------------------------------------------
JUICE = -110.0
BREAKEVEN = 0.524
MIN_CONFIDENCE = 0.535
DEFAULT_THRESHOLD = 4.5
VENUE_POINTS = 3.5
DEFAULT_TEMPO = 67.5
RANKED_ENTITIES = 365
RECENT_DAYS = 14
TOLERANCE_DAYS = 365
REST_DEFAULT = 7
REST_CAP = 14
ROLLING_WINDOW = 10
MIN_PERIODS = 3
HALF_LIFE = 5
EDGE_BUCKETS = [
    (0, 1, "0-1 pts"), (1, 2, "1-2 pts"), (2, 3, "2-3 pts"), (3, 4, "3-4 pts"),
    (4, 5, "4-5 pts"), (5, 7, "5-7 pts"), (7, 10, "7-10 pts"), (10, None, "10+ pts"),
]
SWEEP_VALIDATION = [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0, 7.0]
SWEEP_TEST = [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0, 7.0, 8.0]
SWEEP_FINE = [4.0, 4.25, 4.5, 4.75, 5.0, 5.25, 5.5, 5.75, 6.0]
STABILITY_THRESHOLDS = [3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0]
TEMPERATURE_RANGE = (0.8, 1.5, 15)
PROBABILITY_RANGE = (0.4, 0.7)
TWO_MODEL_WEIGHTS = {"ridge": 0.4, "gbm": 0.6}
THREE_MODEL_WEIGHTS = {"ridge": 0.1, "gbm": 0.2, "dnn": 0.7}
GBT_PARAMS = {
    "maxIter": 200, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 20, "seed": 42,
}
SCORING_DEFAULTS = {
    "rest_days_a": 3.0, "rest_days_b": 3.0, "rest_diff": 0.0, "b2b_a": 0.0, "b2b_b": 0.0,
    "rolling_ats_a": 0.5, "rolling_ats_b": 0.5, "rolling_ats_diff": 0.0,
    "ew_margin_a": 0.0, "ew_margin_b": 0.0, "ew_margin_diff": 0.0,
}

# --- fixed values: feature groups ------------------------------------------
RATINGS_CORE = [
    "kp_adj_em_a", "kp_adj_em_b", "kp_adj_em_diff", "kp_adj_o_a", "kp_adj_o_b",
    "kp_adj_d_a", "kp_adj_d_b", "kp_tempo_a", "kp_tempo_b", "kp_tempo_avg",
]
RATINGS_RANKS = [
    "kp_rank_em_a", "kp_rank_em_b", "kp_rank_oe_a", "kp_rank_oe_b", "kp_rank_de_a", "kp_rank_de_b",
]
RATINGS_MATCHUP = ["kp_o_vs_d_a", "kp_o_vs_d_b", "kp_tempo_diff"]
SITUATIONAL = ["rest_days_a", "rest_days_b", "rest_diff", "b2b_a", "b2b_b"]
ROLLING = ["rolling_ats_a", "rolling_ats_b", "rolling_ats_diff"]
RECENCY = ["ew_margin_a", "ew_margin_b", "ew_margin_diff"]
CONTEXT = ["is_home_a", "is_neutral"]
ALL_FEATURES = RATINGS_CORE + RATINGS_MATCHUP + SITUATIONAL + ROLLING + RECENCY + CONTEXT
ABLATION_SETS = {
    "Core Only": RATINGS_CORE + CONTEXT,
    "+ Rankings": RATINGS_CORE + RATINGS_RANKS + CONTEXT,
    "+ Matchup": RATINGS_CORE + RATINGS_RANKS + RATINGS_MATCHUP + CONTEXT,
    "+ Situational": RATINGS_CORE + RATINGS_RANKS + RATINGS_MATCHUP + SITUATIONAL + CONTEXT,
    "+ Rolling": RATINGS_CORE + RATINGS_RANKS + RATINGS_MATCHUP + SITUATIONAL + ROLLING + CONTEXT,
    "All Features": ALL_FEATURES,
}
CORE_COLUMNS = [
    "game_key", "season", "date", "team_a", "team_b", "is_home_a", "is_neutral",
    "spread_a", "final_margin_a", "cover_a",
]
EW_COLUMNS = ["ew_margin_a", "ew_margin_b", "ew_ppg_a", "ew_ppg_b", "ew_margin_diff"]
SCORED_METADATA = [
    "game_key", "season", "date", "team_a", "team_b", "spread_a", "final_margin_a", "cover_a", "kp_matched",
]

# --- fixed values: raw name -> canonical name ------------------------------
KNOWN_NAMES = {
    "Alabama Crimson Tide": "Alabama",
    "Alabama State Hornets": "Alabama St.",
    "Arkansas-Little Rock Trojans": "Little Rock",
    "Arkansas-Pine Bluff Golden Lions": "Arkansas Pine Bluff",
    "Bethune-Cookman Wildcats": "Bethune Cookman",
    "Cal State-Fullerton Titans": "Cal St. Fullerton",
    "Cal State-Northridge Matadors": "CSUN",
    "Central Connecticut State Blue Devils": "Central Connecticut",
    "Central Florida Knights": "UCF",
    "East Texas A&M Lions": "East Texas A&M",
    "FIU Panthers": "FIU",
    "Florida International Golden Panthers": "FIU",
    "Florida Atlantic Owls": "Florida Atlantic",
    "Hawaii Rainbow Warriors": "Hawaii",
    "Hawai'i Rainbow Warriors": "Hawaii",
    "Illinois-Chicago Flames": "Illinois Chicago",
    "UIC Flames": "Illinois Chicago",
    "IUPUI Jaguars": "IU Indy",
    "Indiana-Purdue-Indianapolis Jaguars": "IU Indy",
    "LIU Sharks": "LIU",
    "Long Island University Sharks": "LIU",
    "Louisiana Ragin Cajuns": "Louisiana",
    "Louisiana-Lafayette Ragin Cajuns": "Louisiana",
    "Louisiana-Monroe Warhawks": "Louisiana Monroe",
    "Loyola (IL) Ramblers": "Loyola Chicago",
    "Loyola Chicago Ramblers": "Loyola Chicago",
    "Loyola (MD) Greyhounds": "Loyola MD",
    "Loyola Marymount Lions": "Loyola Marymount",
    "Miami (FL) Hurricanes": "Miami FL",
    "Miami (OH) RedHawks": "Miami OH",
    "Mississippi Rebels": "Mississippi",
    "Ole Miss Rebels": "Mississippi",
    "Mississippi State Bulldogs": "Mississippi St.",
    "N.C. State Wolfpack": "N.C. State",
    "NC State Wolfpack": "N.C. State",
    "Nebraska-Omaha Mavericks": "Nebraska Omaha",
    "NJIT Highlanders": "NJIT",
    "North Carolina A&T Aggies": "North Carolina A&T",
    "North Carolina Central Eagles": "North Carolina Central",
    "North Carolina Tar Heels": "North Carolina",
    "Northern Kentucky Norse": "Northern Kentucky",
    "Penn Quakers": "Penn",
    "Pittsburgh Panthers": "Pittsburgh",
    "Purdue Fort Wayne Mastodons": "Purdue Fort Wayne",
    "Saint Francis Red Flash": "Saint Francis",
    "Saint Joseph's Hawks": "Saint Joseph's",
    "Saint Mary's Gaels": "Saint Mary's",
    "Saint Peter's Peacocks": "Saint Peter's",
    "Sam Houston Bearkats": "Sam Houston St.",
    "Sam Houston State Bearkats": "Sam Houston St.",
    "San Jose State Spartans": "San Jose St.",
    "SIU-Edwardsville Cougars": "SIUE",
    "SMU Mustangs": "SMU",
    "South Carolina State Bulldogs": "South Carolina St.",
    "South Florida Bulls": "South Florida",
    "Southeast Missouri State Redhawks": "Southeast Missouri",
    "Southeastern Louisiana Lions": "Southeastern Louisiana",
    "Southern Illinois Salukis": "Southern Illinois",
    "Southern Miss Golden Eagles": "Southern Miss",
    "Southern Mississippi Golden Eagles": "Southern Miss",
    "Stephen F. Austin Lumberjacks": "Stephen F. Austin",
    "St. Bonaventure Bonnies": "St. Bonaventure",
    "St. John's Red Storm": "St. John's",
    "St. Thomas Tommies": "St. Thomas",
    "TCU Horned Frogs": "TCU",
    "Texas A&M Aggies": "Texas A&M",
    "Texas A&M-Corpus Christi Islanders": "Texas A&M Corpus Chris",
    "Texas-Arlington Mavericks": "UT Arlington",
    "Texas-Rio Grande Valley Vaqueros": "UT Rio Grande Valley",
    "Texas-San Antonio Roadrunners": "UTSA",
    "Toledo Rockets": "Toledo",
    "Troy Trojans": "Troy",
    "Tulane Green Wave": "Tulane",
    "Tulsa Golden Hurricane": "Tulsa",
    "UAB Blazers": "UAB",
    "UC-Davis Aggies": "UC Davis",
    "UC-Irvine Anteaters": "UC Irvine",
    "UC-Riverside Highlanders": "UC Riverside",
    "UC-San Diego Tritons": "UC San Diego",
    "UC-Santa Barbara Gauchos": "UC Santa Barbara",
    "UCF Knights": "UCF",
    "UCLA Bruins": "UCLA",
    "UMass Minutemen": "Massachusetts",
    "UMass-Lowell River Hawks": "UMass Lowell",
    "UMBC Retrievers": "UMBC",
    "UNC-Asheville Bulldogs": "UNC Asheville",
    "UNC-Greensboro Spartans": "UNC Greensboro",
    "UNC-Wilmington Seahawks": "UNC Wilmington",
    "UNLV Rebels": "UNLV",
    "USC Trojans": "USC",
    "USC-Upstate Spartans": "USC Upstate",
    "UT-Martin Skyhawks": "Tennessee Martin",
    "UTEP Miners": "UTEP",
    "VCU Rams": "VCU",
    "VMI Keydets": "VMI",
    "William & Mary Tribe": "William & Mary",
}

# --- fixed values: opponent short name -> full name ------------------------
OPPONENT_OVERRIDES = {
    "alabama": "alabama crimson tide",
    "illinois": "illinois fighting illini",
    "utah": "utah runnin' utes",
    "delaware": "delaware fightin' blue hens",
    "north dakota": "north dakota fighting hawks",
    "mississippi - ole miss": "ole miss rebels",
    "ole miss": "ole miss rebels",
    "north carolina": "north carolina tar heels",
    "north carolina state": "nc state wolfpack",
    "nc state": "nc state wolfpack",
    "saint mary's-california": "st. mary's gaels",
    "saint mary's": "st. mary's gaels",
    "st. mary's-california": "st. mary's gaels",
    "southern methodist": "smu mustangs",
    "smu": "smu mustangs",
    "st. francis-brooklyn": "st. francis-brooklyn terriers",
    "hartford": "hartford hawks",
    "usc": "southern california trojans",
    "lsu": "louisiana state tigers",
    "uconn": "connecticut huskies",
    "unlv": "nevada-las vegas rebels",
    "vcu": "virginia commonwealth rams",
    "ucf": "central florida knights",
    "pitt": "pittsburgh panthers",
    "penn": "pennsylvania quakers",
    "cal": "california golden bears",
}
