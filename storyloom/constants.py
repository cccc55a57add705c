"""Fixed values of the news domain: word lists, patterns and bounds that results depend on."""

from __future__ import annotations

#: id, name, ownership category, language, logo, method.
PUBLISHERS = [
    ("newsbook", "Newsbook", "church_owned", "en", "https://newsbook.com.mt/favicon.png", "rss"),
    ("lovin_malta", "Lovin Malta", "commercial_independent", "en", "https://lovinmalta.com/wp-content/uploads/2022/09/cropped-fav2022-180x180.png", "rss"),
    ("the_shift", "The Shift News", "investigative_independent", "en", "https://theshiftnews.com/wp-content/uploads/2024/09/favicon.png", "rss"),
    ("malta_today", "Malta Today", "commercial_independent", "en", "https://www.maltatoday.com.mt/ui/images/icons/Icon-60@3x.png", "html"),
    ("independent", "The Malta Independent", "commercial_independent", "en", "https://www.independent.com.mt/favicon.ico", "html"),
    ("tvm_news", "TVM News", "state_owned", "en", "https://tvmnews.mt/favicon.ico", "html"),
    ("one_news", "ONE News", "party_owned_pl", "mt", "https://one.com.mt/wp-content/themes/soledad-child/images/favicon-180.png", "rss"),
    ("net_news", "NET News", "party_owned_pn", "mt", "https://netnews.com.mt/wp-content/themes/netnews/assets/img/logo192x192.png", "html"),
    ("times_of_malta", "Times of Malta", "commercial_independent", "en", "https://timesofmalta.com/apple-touch-icon.png", "sitemap"),
]

#: Ownership categories in their fixed order; the last three are for global sources.
BIAS_CATEGORIES = ["state_owned", "party_owned_pl", "party_owned_pn", "church_owned", "commercial_independent", "investigative_independent", "left", "centre", "right"]
INDEPENDENT = ["commercial_independent", "investigative_independent"]
DEFAULT_BIAS = "commercial_independent"
#: How good a source's headline is as the headline of a story; unknown sources count 1.
SOURCE_SCORE = {"investigative_independent": 4, "commercial_independent": 3, "church_owned": 2, "state_owned": 1, "party_owned_pl": 0, "party_owned_pn": 0}

#: Parts of a URL that give a category; the first hit in this order counts.
URL_CATEGORIES = [
    ("sport", ["/sport", "/sports", "/futbol", "/football", "/soccer", "/rugby", "/tennis", "/f1"]),
    ("politics", ["/politics", "/politika", "/parlament", "/parliament", "/election"]),
    ("crime", ["/crime", "/court", "/police", "/pulizija", "/qorti", "/law-courts"]),
    ("business", ["/business", "/economy", "/finance", "/negozju", "/ekonomija", "/property", "/market"]),
    ("opinion", ["/opinion", "/editorial", "/blog", "/comment", "/columnist", "/letters"]),
    ("entertainment", ["/entertainment", "/culture", "/lifestyle", "/arts", "/music", "/film", "/tv", "/divertiment"]),
    ("international", ["/world", "/international", "/europe", "/global", "/foreign", "/dinja"]),
    ("local", ["/local", "/malta", "/gozo", "/national", "/lokali"]),
]
#: Parts of a headline that give a category where the URL does not.
HEADLINE_CATEGORIES = [
    ("sport", ["football", "goal", "goalkeeper", "referee", "champions league", "premier league", "serie a", "futbol", "marathon", "athlete", "olympic", "fifa", "uefa", "boxing", "mfa", "hibernians", "valletta fc", "hamrun", "floriana", "birkirkara", "sliema wanderers"]),
    ("politics", ["minister", "parliament", "election", "vote", "opposition", "labour party", "nationalist party", "robert abela", "bernard grech", "metsola", "cabinet", "legislation", "bill", "act of parliament", "ministru", "parlament", "elezzjoni"]),
    ("crime", ["arrested", "charged", "murder", "theft", "robbery", "drug", "fraud", "magistrate", "arraigned", "prison", "sentence", "guilty", "victim", "assault", "trafficking", "arrest", "arrestat", "droga"]),
    ("business", ["economy", "investment", "company", "shares", "bank", "profit", "revenue", "startup", "inflation", "gdp", "budget", "tax", "property", "developer", "planning authority", "ekonomija", "negozju"]),
    ("opinion", ["opinion", "editorial", "letter to", "i think", "commentary", "column", "view:", "analysis:"]),
    ("entertainment", ["festival", "concert", "film", "movie", "theatre", "music", "singer", "actor", "actress", "celebrity", "tv show", "netflix", "exhibition", "carnival", "festa", "pjazza"]),
    ("international", ["eu ", "european", "united nations", "nato", "ukraine", "russia", "china", "trump", "biden", "uk ", "italy", "libya", "brussels", "summit", "foreign affairs", "ewropa", "dinja"]),
]

#: Names that are proper nouns wherever they stand in a headline.
ENTITIES = [
    "abela", "grech", "metsola", "muscat", "busuttil", "gonzi", "mintoff", "delia", "bartolo", "bonnici", "scicluna", "mizzi", "fenech", "agius", "cutajar", "falzon", "buhagiar", "zammit", "vassallo", "camilleri",
    "mepa", "mfsa", "mcast", "mita", "enemalta", "wasteserv", "arpa", "mfin", "indis",
    "mdina", "birgu", "senglea", "cospicua", "bormla", "marsaxlokk", "marsaskala", "mellieha", "naxxar", "mosta", "rabat", "qormi", "zejtun", "attard", "balzan", "lija", "iklin", "victoria", "sannat", "xaghra", "xewkija", "gharb", "kercem",
    "adpd",
]

#: Parts and ends of URLs that are not articles; a URL ending in a slash with at most NAV_SLASHES slashes is none either.
NAV_ENDS = ["/news", "/news/", "/sport", "/sport/"]
NAV_PARTS = ["/category/", "/tag/", "/author/", "/page/", "/search", "/about", "/contact", "/privacy", "/terms", "/login", "/register", "/subscribe", "#", "javascript:"]
NAV_SLASHES = 3
#: Headlines that are not articles.
NON_ARTICLE_PARTS = ["front page", "years ago", "obituar", "in memoriam", "sudoku", "crossword", "horoscope"]
NON_ARTICLE_STARTS = ["watch:", "podcast:", "gallery:", "quiz:"]
#: Image URLs that are no picture of a story.
BAD_IMAGE_PARTS = ["gravatar.com", "tracking", "spacer", "blank.gif", "1x1", "/emoji/", "/smilies/", "wp-includes/images/", "data:image"]
BAD_IMAGE_ENDS = [".svg", ".ico"]
#: Attributes of an image tag in the order in which they are tried.
IMAGE_ATTRIBUTES = ['data-original="', 'data-src="', 'data-lazy-src="', 'src="', "data-original='", "data-src='", "data-lazy-src='", "src='"]
#: Containers of an article's text, and patterns of links to articles, in the order in which they are tried.
BODY_CONTAINERS = ["article", ".article-body", ".article-content", ".entry-content", ".post-content", ".story-body", '[itemprop="articleBody"]']
ARTICLE_LINKS = ["article a[href]", "h2 a[href]", "h3 a[href]", "h1 a[href]", ".entry-title a[href]", ".post-title a[href]", ".article-title a[href]", ".news-title a[href]", "[class*='headline'] a[href]", "[class*='title'] a[href]"]
FEED_PATHS = ["/feed", "/rss", "/rss.xml", "/feed.xml", "/feeds/rss.xml", "/atom.xml", "/index.xml", "/news/rss.xml", "/feeds/all.rss.xml"]
SITEMAP_PATHS = ["/sitemap_news.xml", "/news-sitemap.xml", "/sitemap.xml", "/sitemap_latest.xml", "/sitemap_index.xml"]
HTML_ENTITIES = {
    "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘",
    "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&hellip;": "…", "&copy;": "©", "&reg;": "®", "&trade;": "™",
}

#: Bounds of matching a new article to a story.
COSINE_BASE, COSINE_ANCHOR, STALE_FACTOR, STALE_HOURS = 0.35, 0.26, 1.5, 72.0
ANCHOR_MIN_IDF, MIN_SHARED = 3.0, 2
LARGE_BUMP, SMALL_CUT, SAME_PUBLISHER_BUMP = 0.05, 0.03, 0.07
BOOST_MAX, BOOST_HOURS, MERGE_THRESHOLD = 0.20, 12.0, 0.55
INGEST_HOURS, RETENTION_DAYS, SNIPPET_BYTES, HEADLINE_BYTES = 48, 7, 500, (10, 200)

#: Words that tell no stories apart, fixed values that results depend on: places, reporting, time, position, quantity, common verbs,
#: function words, institutions, and function words of Maltese.  ``stop_words`` parameters take another list.
STOP_WORDS = [
    "malta", "maltese", "gozo", "gozitan", "valletta",
    "says", "said", "claims", "claim", "report", "reports", "reported", "confirms", "confirmed", "deny", "denies", "announces", "announced", "statement", "breaking", "exclusive", "updated", "watch", "news",
    "today", "yesterday", "tomorrow", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "week", "weeks", "month", "months", "year", "years", "day", "days", "annual", "weekly", "monthly",
    "first", "second", "third", "last", "next", "new",
    "more", "most", "much", "many", "some", "all", "also", "even", "just", "only", "very", "still", "back", "high", "good", "great", "long", "open", "same", "each", "every", "other", "such", "over", "under", "upon", "part", "need", "want",
    "come", "does", "down", "gets", "give", "goes", "going", "gone", "hold", "held", "know", "left", "like", "look", "made", "make", "take", "tell", "told", "took", "turn", "used", "went", "well", "call", "called", "show", "here", "people",
    "about", "after", "before", "being", "been", "from", "have", "into", "that", "this", "they", "their", "them", "then", "than", "these", "those", "were", "what", "when", "where", "which", "while", "with", "will", "would", "could", "should",
    "police", "court", "judge", "magistrate", "tribunal", "arrest", "arrested", "charged", "convicted", "sentenced", "jailed", "victim", "suspect", "accused", "guilty", "crime", "criminal",
    "government", "minister", "ministry", "parliament", "opposition", "council", "authority", "commission", "board", "committee", "public", "national", "local", "european", "international", "million", "billion", "percent", "according",
    "company", "business", "sector", "school", "university", "hospital", "development", "project", "plan", "proposed", "scheme", "decision", "proposal", "issue", "issues",
    "man", "woman", "family", "children", "residents", "person", "found", "given", "asked", "major", "official", "officials",
    "tal", "tas", "tad", "tar", "taz", "fil", "bil", "mal", "bħal", "dan", "din", "dawn", "dak", "dik", "dawk", "kif", "jew", "imma", "iżda", "wara", "fuq", "taħt", "ġewwa", "barra", "qabel", "waqt",
    "ukoll", "wkoll", "biss", "biex", "minn", "mhux", "meta", "bhal", "hemm", "hawn", "mill", "bejn", "talli", "lanqas", "wisq",
]
