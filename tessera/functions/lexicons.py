"""Fixed values.

Every list and number below must equal the values the ranking and filtering
rules were defined with; results change if any of them change.  They are kept
together, as plain text, in their original order.  Operators take them as
default arguments, so callers can override any of them.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — ranking
# ---------------------------------------------------------------------------

SOURCE_QUALITY = {
    "reuters": 1.00,
    "associated press": 1.00,
    "ap news": 1.00,
    "bbc": 0.98,
    "bbc news": 0.98,
    "the guardian": 0.95,
    "the new york times": 0.95,
    "new york times": 0.95,
    "financial times": 0.95,
    "the washington post": 0.95,
    "cnn": 0.93,
    "abc news": 0.93,
    "cbs news": 0.93,
    "nbc news": 0.93,
    "al jazeera": 0.90,
    "ign": 0.90,
    "ign india": 0.90,
    "gamespot": 0.90,
    "the verge": 0.90,
    "ars technica": 0.90,
    "wired": 0.90,
    "yahoo news": 0.85,
    "yahoo sports": 0.80,
    "gulf news": 0.82,
    "the jerusalem post": 0.82,
    "nature": 0.95,
    "the indian express": 0.88,
    "indian express": 0.88,
    "ndtv": 0.88,
    "the hindu": 0.92,
    "hindustan times": 0.85,
    "times of india": 0.82,
}
UNKNOWN_SOURCE_QUALITY = 0.50

CURRENT_EVENT_TERMS = [
    "announces", "announced", "announcement", "launches", "launched", "launch",
    "releases", "released", "release", "reveals", "revealed", "reveal",
    "unveils", "unveiled", "unveil", "confirms", "confirmed", "confirmation",
    "reports", "reported", "report", "says", "said", "update", "updates",
    "updated", "breaking", "breaks", "new", "newly", "develops", "developed",
    "development", "developing", "signs", "signed", "deal", "agreement",
    "acquires", "acquired", "acquisition", "approves", "approved", "approval",
    "rejects", "rejected", "resigns", "resigned", "resignation", "wins", "won",
    "loses", "lost", "elected", "election", "votes", "voted", "investigation",
    "investigates", "investigated", "lawsuit", "sues", "sued", "ban", "banned",
    "recall", "recalled", "opens", "opened", "closes", "closed", "crashes",
    "crashed", "outage", "outages", "earnings", "profit", "profits", "funding",
    "investment", "researchers", "study", "finds", "found", "discovery",
    "discovers", "discovered", "breakthrough", "leak", "leaked", "leaks",
    "trailer", "footage", "gameplay", "beta", "preview", "dies", "died",
    "death", "arrested", "arrest", "charged", "appointed", "appointment",
    "withdraws", "withdrawn", "extends", "extended", "delays", "delayed",
    "cancels", "cancelled", "canceled", "expands", "expanded", "cuts", "cut",
    "raises", "raised", "falls", "fell", "surges", "surged", "warns", "warned",
]

EVERGREEN_TERMS = [
    "what is", "what are", "what does", "how does", "how to", "guide", "guides",
    "beginners guide", "beginner's guide", "explained", "explainer",
    "everything you need to know", "all you need to know", "history of",
    "introduction to", "introduction", "overview", "definition", "meaning",
    "basics", "fundamentals", "tips", "tutorial", "tutorials", "best ways",
    "why it matters", "why does", "what we know", "what we know so far",
    "things to know", "complete guide", "ultimate guide", "beginner",
    "how to use", "how it works", "explained simply",
]

ANALYSIS_TERMS = [
    "opinion", "analysis", "commentary", "editorial", "column", "perspective",
    "could", "might", "may", "theory", "speculation", "predicts", "prediction",
    "what to expect", "why", "should", "review", "reviews", "hands on",
    "hands-on", "first impressions", "thoughts", "i hope", "we think",
    "our take", "explained",
]

LISTICLE_PHRASES = [
    "games to play", "things to know", "best games", "best ways", "top games",
    "top reasons", "reasons why", "alternatives", "movies to watch",
    "shows to watch",
]

# Signal weights, duplicate threshold, per-source cap.
WEIGHTS = {
    "semantic": 0.45,
    "freshness": 0.15,
    "source": 0.10,
    "title": 0.15,
    "newsworthiness": 0.15,
}
SIMILARITY_THRESHOLD = 0.80
MAX_PER_SOURCE = 3

# Freshness: exp(-(0.693 / 48) * age_hours); unknown date scores 0.50.
FRESHNESS_DECAY = 0.693 / 48.0
FRESHNESS_DEFAULT = 0.50

# Newsworthiness increments and caps.
NEWS_BASE = 0.50
CURRENT_EVENT_STEP, CURRENT_EVENT_CAP = 0.075, 6
EVERGREEN_STEP, EVERGREEN_CAP = 0.10, 5
ANALYSIS_STEP, ANALYSIS_CAP = 0.065, 5
QUESTION_PENALTY = 0.06
EXPLAINER_PENALTY = 0.10
YEAR_PENALTY = 0.08
LISTICLE_PENALTY = 0.10

# Title relevance mix.
TITLE_COVERAGE_W, TITLE_ORDERED_W, TITLE_DOMINANCE_W = 0.60, 0.25, 0.15

# ---------------------------------------------------------------------------
# FIXED VALUES — retrieval filters
# ---------------------------------------------------------------------------

STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with",
    "from", "by", "at", "is", "are", "was", "were", "be", "as", "it", "its",
    "this", "that", "latest", "news", "update", "updates",
]

QUERY_ALIASES = {
    "gta 6": ["gta 6", "gta vi", "grand theft auto 6", "grand theft auto vi"],
    "donald trump": ["donald trump", "trump"],
    "artificial intelligence": ["artificial intelligence", "ai"],
}

LANDING_PAGE_PATTERNS = [
    r"\bbreaking news\b",
    r"\blatest news\b",
    r"\blive updates\b",
    r"\bnews and videos\b",
    r"\bnews hub\b",
    r"\bnews roundup\b",
    r"\bhomepage\b",
    r"\bhome page\b",
    r"\bcategory\b",
    r"\btopic page\b",
    r"\ball news\b",
    r"\blatest stories\b",
]

EVERGREEN_PATTERNS = [
    r"^what is\b",
    r"^what are\b",
    r"^how to\b",
    r"^how does\b",
    r"^why is\b",
    r"\bexplained\b",
    r"\bguide\b",
    r"\bbest .* to\b",
    r"\bgames to play\b",
    r"\bthings to know\b",
    r"\beverything you need to know\b",
    r"\bwhat you need to know\b",
]

ANALYSIS_PATTERNS = [
    r"\bopinion\b",
    r"\banalysis\b",
    r"\bcommentary\b",
    r"\beditorial\b",
    r"\bcolumn\b",
    r"\btheory\b",
    r"\bprediction\b",
    r"\bpredictions\b",
]

MIN_TITLE_CHARS = 10
MIN_SUMMARY_CHARS = 20
MAX_AGE_HOURS = 72
QUERY_LIMIT = 50
LIMIT_PER_SOURCE = 10
DEFAULT_SOURCE = "Google News"

# Search request URL around the url-encoded query.
SEARCH_URL_PREFIX = "https://news.google.com/rss/search?q="
SEARCH_URL_SUFFIX = "&hl=en-IN&gl=IN&ceid=IN:en"

# Feed catalogue: category -> [(source, url)], in catalogue order.
FEED_CATALOGUE = {
    "tech": [
        ("Ars Technica", "https://feeds.arstechnica.com/arstechnica/index"),
        ("The Verge", "https://www.theverge.com/rss/index.xml"),
        ("TechCrunch", "https://techcrunch.com/feed/"),
        ("BBC News", "https://feeds.bbci.co.uk/news/technology/rss.xml"),
    ],
    "gaming": [
        ("Polygon", "https://www.polygon.com/rss/index.xml"),
        ("GameSpot", "https://www.gamespot.com/feeds/mashup/"),
        ("Nintendo Life", "https://www.nintendolife.com/feeds/latest"),
    ],
    "entertainment": [
        ("Variety", "https://variety.com/feed/"),
        ("Deadline", "https://deadline.com/feed"),
        ("Hollywood Reporter", "https://www.hollywoodreporter.com/feed/"),
    ],
    "business": [
        ("CNBC", "https://www.cnbc.com/id/100003114/device/rss/rss.html"),
        ("TechCrunch", "https://techcrunch.com/feed/"),
        ("BBC News", "https://feeds.bbci.co.uk/news/business/rss.xml"),
    ],
    "politics": [
        ("BBC News", "https://feeds.bbci.co.uk/news/politics/rss.xml"),
    ],
    "world": [
        ("BBC News", "https://feeds.bbci.co.uk/news/world/rss.xml"),
        ("Al Jazeera", "https://www.aljazeera.com/xml/rss/all.xml"),
    ],
}

# ---------------------------------------------------------------------------
# FIXED VALUES — decisions
# ---------------------------------------------------------------------------

ALLOWED_CATEGORIES = [
    "tech", "gaming", "entertainment", "sports", "politics", "science",
    "business", "social_media", "general",
]
MAX_ATTEMPTS = 3
INVALID_CRITIC_FEEDBACK = (
    "Critic returned invalid JSON. Generate a substantially better post."
)

# ---------------------------------------------------------------------------
# FIXED VALUES — corpus curation
# ---------------------------------------------------------------------------

TOMBSTONES = ["[deleted]", "[removed]"]
MIN_TEXT_CHARS = 20
JOKE_BUCKETS = 5
JOKE_SAMPLE_CAP = 10000
SAMPLE_SEED = 42
