"""Fixed values.

They have to equal the values of the data model this package serves, or results differ.
"""

# Category ids and names ("Comedy" occurs twice).
CATEGORIES = [
    (1, "Film & Animation"),
    (2, "Autos & Vehicles"),
    (10, "Music"),
    (15, "Pets & Animals"),
    (17, "Sports"),
    (18, "Short Movies"),
    (19, "Travel & Events"),
    (20, "Gaming"),
    (21, "Videoblogging"),
    (22, "People & Blogs"),
    (23, "Comedy"),
    (24, "Entertainment"),
    (25, "News & Politics"),
    (26, "Howto & Style"),
    (27, "Education"),
    (28, "Science & Technology"),
    (29, "Nonprofits & Activism"),
    (30, "Movies"),
    (31, "Anime/Animation"),
    (32, "Action/Adventure"),
    (33, "Classics"),
    (34, "Comedy"),
    (35, "Documentary"),
    (36, "Drama"),
    (37, "Family"),
    (38, "Foreign"),
    (39, "Horror"),
    (40, "Sci-Fi/Fantasy"),
    (41, "Thriller"),
    (42, "Shorts"),
    (43, "Shows"),
    (44, "Trailers"),
]

# Holidays with a fixed date, as (month, day).
FIXED_HOLIDAYS = [(1, 1), (6, 5), (12, 24), (12, 25), (12, 26), (12, 31)]

# Local zone and session gap of the published views.
LOCAL_ZONE = "Europe/Copenhagen"
SESSION_GAP_MINUTES = 45

# The export's title prefix and the name that marks an advertisement.
TITLE_PREFIX = "Watched "
AD_MARKER = "From Google Ads"

# States a video can be in.
VIDEO_STATUSES = ["active", "unavailable", "private"]

# Ids per metadata request and requests per day.
REQUEST_SIZE = 50
REQUESTS_PER_DAY = 10_000

# Noise removed from descriptions, in this order, and the length kept.
URL_PATTERN = r"https?://\S+|www\.\S+"
CLOCK_PATTERN = r"\b\d{1,2}:\d{2}(?::\d{2})?\b"
HASHTAG_PATTERN = r"#\w+"
CALL_TO_ACTION_PATTERN = (
    r"(subscribe|click the bell|hit the bell|turn on notifications"
    r"|follow us|join the channel|support us on patreon"
    r"|check out our merch|link in (the )?bio|link in description"
    r"|use code \w+|affiliate link|sponsored by|this video (is )?sponsored)"
)
SOCIAL_PATTERN = (
    r"(instagram|twitter|tiktok|facebook|twitch|discord|reddit"
    r"|linkedin|snapchat)\s*[:\-@]?\s*@?\w*"
)
DESCRIPTION_CHARS = 512

# Scripts and letters that give a language away, first match wins.
SCRIPT_PATTERNS = [
    ("da", "[æøåÆØÅ]"),
    ("ka", r"[\x{10D0}-\x{10FF}\x{1C90}-\x{1CBF}]"),
    ("de", "[ß]"),
    ("es", "[ñÑ¿¡]"),
    ("ru", r"[\x{0400}-\x{04FF}]"),
    ("ar", r"[\x{0600}-\x{06FF}]"),
    ("ja", r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"),
    ("ko", r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]"),
]

# Language codes a reviewer may enter.
LANGUAGE_CODES = [
    "en", "da", "ka", "de", "es", "fr", "nl", "no", "sv",
    "it", "pt", "pl", "ru", "ar", "ja", "ko", "zh", "fi",
    "hu", "cs", "ro", "tr", "he", "vi", "th", "id", "ms",
]

# Channels are reviewed from this many views, on this many newest titles.
REVIEW_MIN_VIEWS = 10
REVIEW_TITLES = 20

# Columns of the channel review file, in order.
REVIEW_COLUMNS = [
    "channel_id",
    "channel_name",
    "total_views",
    "existing_language",
    "existing_source",
    "unicode_detected",
    "mistral_guess",
    "detection_method",
    "primary_language",
    "notes",
]

# Openings that mark a supplied label as a refusal, and the label length.
REFUSALS = [
    "i cannot", "i'm unable", "i am unable",
    "i apologize", "i'm sorry", "i am sorry",
    "not appropriate", "harmful content",
    "i can't", "i will not", "i won't",
]
LABEL_CHARS = 100

# Embedding size, encoder batch, smallest topic, stored keywords, seed.
EMBEDDING_DIM = 384
ENCODE_BATCH = 64
MIN_TOPIC_SIZE = 10
STORED_KEYWORDS = 15
REPORT_KEYWORDS = 10
TOPIC_SEED = 42

# Default stop words of the keyword job: common English function words. A parameter.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before "
    "being below between both but by can could did do does doing down during each few for "
    "from further had has have having he her here hers him his how i if in into is it its "
    "just me more most my no nor not now of off on once only or other our ours out over own "
    "same she should so some such than that the their theirs them then there these they "
    "this those through to too under until up very was we were what when where which while "
    "who whom why will with would you your yours"
).split()
