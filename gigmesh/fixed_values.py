"""Fixed values.

Word lists, lookup tables, constants and patterns that decide results. They are
data, not logic: each must hold exactly these entries for outputs to agree with
the listings this library replaces.
"""

# -- horizon and freshness (fixed values) ----------------------------------
WEEKS_AHEAD = 43
SNAPSHOT_TTL_HOURS = 12
SNAPSHOT_PRUNE_HOURS = 48
RECURRING_WEEKS = 4
MAX_STRUCTURED_ITEMS = 50
DEFAULT_TIME = "8pm"
DEFAULT_AGE = "a/a"
DEFAULT_LOCATION = "Boston"

# -- fuzzy thresholds, percent (fixed values) --------------------------------
NAME_RATIO = 80
PARTIAL_RATIO = 95
TOKEN_SET_RATIO = 95
BAND_MERGE_ABOVE = 90
PRIORITY_BAND_ABOVE = 90
BAND_UPGRADE_EXTRA_CHARS = 5
SAME_SHOW_MINUTES = 60

# -- source reliability, smaller is better (fixed values) --------------------
SOURCE_PRIORITY = {
    "ticketmaster": 1,
    "scrape:safe_in_a_crowd": 2,
    "scrape:middle_east": 3,
    "scrape:do617": 4,
}
SOURCE_PRIORITY_OTHER = 99

# -- genres and bands (fixed values) -----------------------------------------
GENRE_INCLUDE = [
    "punk", "hardcore", "post-hardcore", "metalcore", "metal",
    "ska", "oi", "crust", "grindcore", "powerviolence", "noise rock",
    "post-punk", "garage", "psychobilly", "street punk", "pop punk",
    "emo", "screamo", "thrash", "crossover", "d-beat", "anarcho-punk",
    "horror punk", "surf punk", "skate punk", "melodic hardcore",
]
GENRE_EXCLUDE = [
    "country", "jazz", "classical", "r&b", "hip-hop", "rap",
    "edm", "electronic", "dance", "house", "techno", "trance",
    "latin", "reggaeton", "k-pop", "pop",
]
PRIORITY_BANDS = [
    "Converge", "Have Heart", "Bane", "American Nightmare",
    "Dropkick Murphys", "Street Dogs", "Slapshot", "DYS", "SSD",
    "Gang Green", "The FUs", "Negative FX", "Jerry's Kids",
    "Mission of Burma", "Pixies", "Dinosaur Jr.", "Sebadoh",
    "Cave In", "Doomriders", "Defeater", "Shipwreck", "Fiddlehead",
    "The Hope Conspiracy", "Panic", "Righteous Jams", "Mental",
    "Big D and the Kids Table", "The Mighty Mighty Bosstones",
    "Bim Skala Bim", "Westbound Train", "Pile", "Krill", "Kal Marks",
    "Speedy Ortiz", "Palehound", "Vein.fm", "Knocked Loose",
]
BAND_KEYWORDS = [
    "punk", "hardcore", "crust", "grind", "thrash", "doom",
    "sludge", "death", "black", "metal", "noise", "power",
    "violence", "chaos", "destroy", "dead", "hate", "war",
    "blood", "death", "murder", "kill", "rot", "grave",
]
GENRE_VENUES_PRIMARY = [
    "middleeast", "obriens", "elks", "vfw", "legion", "greatscott", "midway", "deepcuts",
]
GENRE_VENUES_FRIENDLY = ["paradise", "sinclair", "brighton", "royale", "palladium"]
GENRE_SOURCES = ["scrape:safe_in_a_crowd"]
CHAIN_VENUES = [
    "bignight", "brighton", "hob", "mgm",
    "orpheum", "palladium", "paradise", "pavilion",
    "roadrunner", "royale", "sinclair", "td",
    "thegrand", "wilbur", "xfinity",
    "higherground",
]

# -- band names (fixed values) -------------------------------------------------
BAND_CORRECTIONS = {
    "dropkick murphy's": "Dropkick Murphys",
    "dropkick murphys": "Dropkick Murphys",
    "mighty mighty bosstones": "The Mighty Mighty Bosstones",
    "bosstones": "The Mighty Mighty Bosstones",
    "dinosaur jr": "Dinosaur Jr.",
    "dinosaur jr.": "Dinosaur Jr.",
}
BAND_SEPARATORS = [" w/ ", " with ", " and ", " + ", " / ", " | "]
LINE_BAND_SEPARATORS = [", ", " w/ ", " with ", " + ", " and ", " & "]
LINE_VENUE_SEPARATORS = [" at ", " @ ", " - "]

# -- venues and places (fixed values) -------------------------------------------
VENUE_NAMES = {
    "middle east": "Middle East",
    "middle east downstairs": "Middle East Downstairs",
    "middle east upstairs": "Middle East Upstairs",
    "the middle east upstairs": "Middle East Upstairs",
    "the middle east downstairs": "Middle East Downstairs",
    "the middle east corner bar": "Middle East Corner",
    "middle east - downstairs": "Middle East Downstairs",
    "middle east- downstairs": "Middle East Downstairs",
    "middle east - upstairs": "Middle East Upstairs",
    "middle east - corner/bakery": "Middle East Corner",
    "middle east - zuzu": "Middle East ZuZu",
    "paradise rock club": "Paradise Rock Club",
    "paradise": "Paradise Rock Club",
    "paradise rock club presented by citizens": "Paradise Rock Club",
    "the sinclair": "The Sinclair",
    "sinclair": "The Sinclair",
    "the sinclair music hall": "The Sinclair",
    "royale": "Royale",
    "royale boston": "Royale",
    "roadrunner": "Roadrunner",
    "roadrunner-boston": "Roadrunner",
    "lizard lounge": "Lizard Lounge",
    "house of blues": "House of Blues",
    "house of blues boston": "House of Blues",
    "citizens house of blues boston": "House of Blues",
    "brighton music hall": "Brighton Music Hall",
    "brighton music hall presented by citizens": "Brighton Music Hall",
    "orpheum": "Orpheum Theatre",
    "orpheum theatre": "Orpheum Theatre",
    "orpheum theatre presented by citizens": "Orpheum Theatre",
    "great scott": "Great Scott",
    "crystal ballroom": "Crystal Ballroom",
    "crystal ballroom at somerville theatre": "Crystal Ballroom",
    "jungle": "Jungle",
    "jungle  tix": "Jungle",
    "midway cafe": "Midway Cafe",
    "o'brien's pub": "O'Brien's Pub",
    "obriens": "O'Brien's Pub",
    "sally o'brien's": "Sally O'Brien's",
    "sallyobriens": "Sally O'Brien's",
    "sally obriens": "Sally O'Brien's",
    "the rockwell": "The Rockwell",
    "deep cuts": "Deep Cuts",
    "groton hill music center": "Groton Hill Music Center",
    "groton hill": "Groton Hill Music Center",
    "symphony hall": "Symphony Hall",
    "boston symphony orchestra": "Symphony Hall",
    "wally's cafe": "Wally's Cafe Jazz Club",
    "wally's cafe jazz club": "Wally's Cafe Jazz Club",
    "wallys cafe": "Wally's Cafe Jazz Club",
    "wallys cafe jazz club": "Wally's Cafe Jazz Club",
    "wally's pub": "Wally's Pub",
    "wallys pub": "Wally's Pub",
    "wally's": "Wally's Pub",
}
HOME_LOCATIONS = {
    "boston": "Boston",
    "boston, ma": "Boston",
    "cambridge": "Cambridge",
    "cambridge, ma": "Cambridge",
    "somerville": "Somerville",
    "somerville, ma": "Somerville",
    "allston": "Allston",
    "allston, ma": "Allston",
    "jamaica plain": "Jamaica Plain",
    "jp": "Jamaica Plain",
    "brookline": "Brookline",
    "worcester": "Worcester",
    "orlando": "Boston",
}
AWAY_LOCATIONS = {
    "providence": "Providence, RI",
    "providence, ri": "Providence, RI",
    "derry": "Derry, NH",
    "derry, nh": "Derry, NH",
    "hampton": "Hampton, NH",
    "hampton, nh": "Hampton, NH",
    "portland": "Portland, ME",
    "portland, me": "Portland, ME",
    "burlington": "Burlington, VT",
    "burlington, vt": "Burlington, VT",
    "new haven": "New Haven, CT",
    "new haven, ct": "New Haven, CT",
    "hartford": "Hartford, CT",
    "hartford, ct": "Hartford, CT",
}
LINE_VENUE_IDS = {
    "middle east": "middleeast",
    "middle east downstairs": "middleeast_down",
    "middle east upstairs": "middleeast_up",
    "paradise": "paradise",
    "paradise rock club": "paradise",
    "the sinclair": "sinclair",
    "sinclair": "sinclair",
    "roadrunner": "roadrunner",
    "royale": "royale",
    "house of blues": "hob_boston",
    "hob": "hob_boston",
    "great scott": "greatscott",
    "brighton music hall": "brighton",
    "o'brien's": "obriens",
    "o'brien's pub": "obriens",
    "obriens": "obriens",
    "sally o'brien's": "sallyobriens",
    "midway": "midway",
    "midway cafe": "midway",
    "jungle": "jungle",
    "crystal ballroom": "crystal",
    "lizard lounge": "lizardlounge",
    "the rockwell": "rockwell",
    "rockwell": "rockwell",
    "deep cuts": "deepcuts",
    "groton hill": "grotonhill",
    "groton hill music center": "grotonhill",
    "wanna hear it records": "wanna_hear_it",
    "plough and stars": "ploughandstars",
    "the plough and stars": "ploughandstars",
}
API_A_VENUE_IDS = {
    "KovZpZAEekIA": "paradise",
    "KovZpZAFnIEA": "hob",
    "KovZpZAFaJkA": "royale",
    "KovZpZAJFl6A": "sinclair",
    "KovZpZAJFkkA": "brighton",
    "KovZpZAFaEJA": "middleeast",
    "KovZpZAFaE7A": "orpheum",
    "KovZpZAEdFIA": "palladium",
}
DEFAULT_VENUES = [
    # id, name, location, address, phone, website, capacity, notes
    ("middleeast", "Middle East", "Cambridge", "472-480 Massachusetts Ave, Cambridge, MA 02139",
     "(617) 864-3278", "https://mideastclub.com", 575, None),
    ("paradise", "Paradise Rock Club", "Boston", "967 Commonwealth Ave, Boston, MA 02215",
     "(617) 562-8800", "https://crossroadspresents.com/paradise-rock-club", 933, None),
    ("sinclair", "The Sinclair", "Cambridge", "52 Church St, Cambridge, MA 02138",
     "(617) 547-5200", "https://sinclaircambridge.com", 525, None),
    ("brightonmusichall", "Brighton Music Hall", "Allston", "158 Brighton Ave, Allston, MA 02134",
     "(617) 779-0140", "https://crossroadspresents.com/brighton-music-hall", 450, None),
    ("royale", "Royale", "Boston", "279 Tremont St, Boston, MA 02116",
     "(617) 338-7699", "https://royaleboston.com", 1200, None),
    ("palladium", "The Palladium", "Worcester", "261 Main St, Worcester, MA 01608",
     "(508) 797-9696", "https://thepalladium.net", 2000, None),
    ("obriens", "O'Brien's Pub", "Allston", "3 Harvard Ave, Allston, MA 02134",
     "(617) 782-6245", None, 100, "Key DIY/punk venue"),
    ("midway", "The Midway Cafe", "Jamaica Plain", "3496 Washington St, Jamaica Plain, MA 02130",
     "(617) 524-9038", "https://midwaycafe.com", 100, "Long-running punk/queer venue"),
    ("oncesomerville", "ONCE Somerville", "Somerville", "156 Highland Ave, Somerville, MA 02143",
     None, "https://oncesomerville.com", 400, None),
    ("roadrunner", "Roadrunner", "Boston", "89 Guest St, Boston, MA 02135",
     None, "https://roadrunnerboston.com", 3500, None),
    ("houseoflues", "House of Blues", "Boston", "15 Lansdowne St, Boston, MA 02215",
     "(888) 693-2583", "https://houseofblues.com/boston", 2425, None),
]

# -- recurring schedule (fixed values) --------------------------------------------
RECURRING_SOURCE = "recurring:wallys_cafe"
RECURRING_VENUE = ("wallys_cafe", "Wally's Cafe Jazz Club", "Boston")
RECURRING_SCHEDULE = [
    (["wednesday", "thursday", "friday", "saturday"], "7pm",
     ["Jazz / Jam / Improv Set"], ["jazz", "straight-ahead jazz", "improvised"]),
    (["wednesday", "thursday", "friday", "saturday", "sunday"], "10pm",
     ["Late Night Set (Rotating Bands)"], ["jazz", "soul", "latin jazz", "improvised"]),
    (["tuesday"], "8pm", ["Wally's Night Band"], ["jazz", "improvised", "jam session"]),
]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3,
    "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}

# -- words in event titles (fixed values) ------------------------------------------------
OTHER_EVENT_WORDS = [
    "swing", "salsa class", "latin dance class", "dance class", "dance lesson",
    "ballroom", "tango class", "bachata class",
    "farmers market", "flea market", "craft fair", "bazaar", "holiday market",
    "artisan market", "vintage market",
    "workshop", "yoga", "meditation", "pilates", "fitness", "training session",
    "art class", "painting class", "pottery", "crafting",
    "comedy", "stand-up", "open mic comedy", "improv", "storytelling",
    "poetry slam", "poetry workshop", "the moth", "storyslam",
    "wrestling", "trivia", "game night", "bingo", "karaoke",
    "ttrpg", "rpg convention", "board game",
    "meeting", "club meeting", "networking", "mixer",
    "brunch", "breakfast", "luncheon",
    "kids", "children's", "family day", "storytime",
    "wellness", "healing", "reiki", "sound bath",
]
MUSIC_WORDS = [
    "concert", "live music", "band", "singer", "songwriter", "jazz",
    "rock", "punk", "metal", "folk", "blues", "reggae", "ska",
    "hip hop", "rap", "r&b", "soul", "funk", "electronic", "dj set",
    "orchestra", "symphony", "chamber", "quartet", "trio",
    "album release", "record release", "tour", "farewell show",
]

# -- published pages (fixed values): page, priority, change frequency ---------------
STATIC_PAGES = [
    ("index.html", "1.0", "weekly"),
    ("list.html", "1.0", "daily"),
    ("clubs.html", "0.8", "weekly"),
    ("by-band.html", "0.8", "daily"),
    ("by-club.html", "0.8", "daily"),
]

# -- patterns (fixed values) -----------------------------------------------------------
ID_CUT_FEATURING = r"\s+(ft\.?|feat\.?|featuring|w/|with|and|&)\s+.*$"
ID_CUT_SHOW_SUFFIX = r"\s*[-:]\s+.*?(tour|live|concert|show|presents|anniversary).*$"
ID_CUT_YEAR_SUFFIX = r"\s*[-:]\s+\d{4}.*$"
ID_PARENTHESES = r"\s*\([^)]*\)\s*"
BAND_ARTICLE_AND_SUFFIX = r"^(?:the\s+)?(.+?)(?:\s+band)?$"
RESOLVER_LEADING_THE = r"^the\s+"
RESOLVER_TRAILING_THE = r",\s*the$"
RESOLVER_CITY_SUFFIX = r"\s*[-–]\s*(boston|cambridge|somerville|brookline|allston|brighton).*$"
CLOCK = r"(\d{1,2})(?::(\d{2}))?\s*(am|pm)?"
CLOCK_ANCHORED = r"^(\d+)(?::(\d+))?\s*(am|pm)?"
CLOCK_SORT = r"^(\d{1,2})(?::(\d{2}))?\s*(am|pm)?"
AMOUNT = r"\$?(\d+(?:\.\d{2})?)"
FREE_WORDS = ["free", "no cover", "donation", "pwyc"]
