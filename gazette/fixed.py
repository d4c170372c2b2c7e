"""Lists, tables, patterns and formats that results depend on. Nothing here is computed."""

from __future__ import annotations

# --- Fixed values: publication source of a link's host or publication handle -------------------
SOURCE_OF = {
    "airbnb-engineering": "airbnb",
    "amazon.science": "amazon",
    "anthropic.com": "anthropic",
    "aws.amazon.com": "aws",
    "deepmind.google": "google",
    "research.google": "google",
    "huggingface.co": "huggingface",
    "tech.kakao.com": "kakao",
    "linkedin.com": "linkedin",
    "ai.meta.com": "meta",
    "engineering.fb.com": "meta",
    "microsoft.com": "microsoft",
    "ncsoft.github.io": "ncsoft",
    "netflixtechblog.com": "netflix",
    "netflix-techblog": "netflix",
    "developer.nvidia.com": "nvidia",
    "openai.com": "openai",
    "blog.palantir.com": "palantir",
    "palantir": "palantir",
    "pinterest-engineering": "pinterest",
    "pinterest_engineering": "pinterest",
    "qwenlm.github.io": "qwen",
    "x.ai": "xai",
    "eugeneyan.com": "eugene_yan",
    "sebastianraschka.com": "sebastian_raschka",
    "magazine.sebastianraschka.com": "sebastian_raschka",
    "philschmid.de": "phil_schmid",
}
#: The host whose first path segment names the publication.
HANDLE_HOST = "medium.com"
UNKNOWN = "unknown"

# --- Fixed values: words that name no subject ---------------------------------------------------
NAV_WORDS = (
    "all", "archive", "back", "blog", "continue", "featured", "first", "home", "index", "last",
    "latest", "learn", "more", "new", "newer", "news", "next", "older", "page", "pages", "post",
    "posts", "prev", "previous", "read", "reading", "see", "start", "view",
)
TITLE_STOPWORDS = ("a", "an", "and", "at", "by", "for", "in", "of", "on", "the", "to", "with")
TITLE_MAX_CHARS = 250
CALL_TO_ACTION = r"(?i)^\s*(?:read|view|see|open|go\s+to|learn\s+more\s+about|(?:blog\s+)?post\s+link\s+to)\s+(?=\S)"

# --- Fixed values: defaults and limits ----------------------------------------------------------
DEFAULT_TAGS = ("uncategorized",)
MAX_TAGS = 5
MIN_CONTENT_LENGTH = 600
MIN_SCORE = 0.7
FULL_SCRAPE_THRESHOLD = 3000
CONTAINER_SHARE = 0.5
CLIP_BYTES = 102_400
PAGE_STEP = 1950
SAFE_SCHEMES = ("http", "https", "mailto")

# --- Fixed values: the score grid and the band of each anchor -----------------------------------
GRID_STEP = 0.05
ANCHOR_BANDS = (
    (0.85, "high"),
    (0.80, "high"),
    (0.75, "high"),
    (0.70, "strong"),
    (0.60, "moderate"),
    (0.50, "moderate"),
    (0.35, "weak"),
    (0.15, "reject"),
    (0.05, "reject"),
)

# --- Fixed values: reading speed (unit, amount a minute) -----------------------------------------
READING_SPEED = {"ko": ("chars", 450), "en": ("words", 200)}

# --- Fixed values: labels of an issue ------------------------------------------------------------
LABELS = {
    "ko": {"published_on": "발행", "view_more": "원문 보기", "resources": "함께 볼 자료", "reading_time": "읽는 시간 {minutes}분", "relevance": "관련도 점수"},
    "en": {"published_on": "Published on", "view_more": "Read the original", "resources": "Further reading", "reading_time": "{minutes} min read", "relevance": "Relevance score"},
}

# --- Fixed values: HTML -----------------------------------------------------------------------
CONTENT_SELECTORS = ("article", "main", "div.post-content", "div.entry-content", "div.content", "div.blog-content", "div.article-content")
NON_CONTENT_TAGS = ("script", "style", "svg", "iframe", "form", "nav", "footer", "template")
CONTENT_ATTRIBUTES = ("src", "href", "alt", "srcset", "colspan", "rowspan", "class")
ALLOWED_TAGS = (
    "a", "b", "blockquote", "br", "code", "col", "colgroup", "del", "div", "em", "figcaption", "figure",
    "h1", "h2", "h3", "h4", "h5", "h6", "hr", "i", "img", "li", "ol", "p", "pre", "span", "strong",
    "sub", "sup", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
ALLOWED_ATTRIBUTES = {
    "a": ("href", "title"),
    "img": ("src", "alt", "title"),
    "code": ("class",),
    "pre": ("class",),
    "table": ("class",),
    "td": ("colspan", "rowspan"),
    "th": ("colspan", "rowspan"),
}

# --- Fixed values: the writing rubric (Korean prose) ----------------------------------------------
LENGTH_BAND = (4000, 6000)
LEDE_BAND = (40, 100)
SPECIFICITY_SATURATION = 6.0
SECTION_MARKERS = ("📌", "🔄", "🛠️", "📊", "🔮")
REQUIRED_SECTIONS = ("📌", "🛠️")
EARLIER_SECTIONS = ("📌", "🔄", "🛠️")
RESULTS_SECTION = "📊"
TERMINAL_COLON = r"([다요죠]):(?=\s*(?:<|$))(?!\s*(?:(?:</[^>]+>|<br\s*/?>)\s*)*<[uo]l\b)"
BANNED_CLOSINGS = ("주목할 만한 참고 자료", "개발자와 아키텍트에게", "참고할 만한 자료입니다", "좋은 참고가 될 것입니다")
BANNED_OPENERS = ("이 글은", "이 아티클은", "이 문서는", "본 글은", "이 포스트는")
ABSENCE_FILLER = ("정보가 없습니다", "언급되지 않았습니다", "확인할 수 없습니다", "명시되어 있지 않습니다")
MEASURED = (
    r"\d[\d,.]*\s*(?:%|퍼센트|배속|배|밀리초|ms|초|분|시간|GiB|MiB|GB|MB|KB|TB|"
    r"Gbps|Mbps|[Bb]ps|fps|토큰|tokens?|vCPU|GPU|원|달러|USD|건|개|회|포인트|x(?=\s|$))"
)
TRANSLATIONESE = {
    "~를 통해": r"(?:을|를) 통(?:해|하여)",
    "~에 대한": r"에 (?:대해|대한|대하여)",
    "~하는 것": r"[가-힣]는 것(?:이|은|을|과|와|입니다)",
    "복수 -들": r"(?<=[가-힣A-Za-z0-9])들(?=[이은을의과와에로])",
    "제공/지원합니다": r"(?:제공|지원)(?:합니다|됩니다|하는|되는|하며|되며)",
    "~에 의해": r"에 의(?:해|하여)",
}
CLICHES = {
    "칭찬 형용사": r"(?:혁신적|획기적|강력한|놀라운|인상적인|매력적인|눈부신)",
    "다양한": r"다양한",
    "단순히 X가 아니라": r"단순(?:한|히|하게)?\s*[^.]{0,25}?(?:가|이|것이)\s*아니(?:라|고|며)",
    "~라는 점입니다": r"(?:라는|다는) 점(?:입니다|이며|이라|에서|은|을)",
    "메타 서술": r"(?:살펴보|알아보|짚어보|정리해\s*보)(?:겠습니다|았습니다|면)|결론적으로|요약하(?:면|자면)|종합하(?:면|자면)",
}
TRANSLATIONESE_BAND = (1.0, 5.0)
CLICHE_BAND = (0.3, 2.0)
DIMENSIONS = ("length", "structure", "register", "terminal_colon", "distinctiveness", "specificity", "boilerplate", "lede", "caption", "translationese", "cliche")
