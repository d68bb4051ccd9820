"""Fixed values. These must equal the ones users rely on, so they are stated plainly."""

from __future__ import annotations

# API path patterns, matched without case.
API_PATTERNS = [
    # REST
    r"/api/v\d+",
    r"/api/[\w-]+",
    r"/v\d+/[\w-]+",
    r"/rest/[\w-]+",
    r"/services/[\w-]+",
    r"/webapi/[\w-]+",
    r"/web-api/[\w-]+",
    r"/ajax/[\w-]+",
    r"/json/[\w-]+",
    r"/data/[\w-]+",
    r"/endpoints/[\w-]+",
    # GraphQL
    r"/graphql",
    r"/gql",
    r"/query",
    # sockets
    r"wss?://[\w.-]+(?:/[\w.-]+)*",
    r"/ws(?:/|$)",
    r"/websocket",
    r"/socket\.io",
    # accounts
    r"/auth(?:/|$)",
    r"/authenticate",
    r"/oauth",
    r"/token",
    r"/login",
    r"/logout",
    r"/register",
    r"/user(?:s)?(?:/|$)",
    r"/account(?:s)?(?:/|$)",
    r"/profile(?:s)?(?:/|$)",
    # actions
    r"/search",
    r"/query",
    r"/get[\w-]*",
    r"/post[\w-]*",
    r"/update[\w-]*",
    r"/delete[\w-]*",
    r"/create[\w-]*",
    r"/list[\w-]*",
    r"/fetch[\w-]*",
    # documentation
    r"/swagger",
    r"/api-docs",
    r"/docs/api",
    r"/documentation/api",
    r"/openapi",
    r"/redoc",
    r"/rapidoc",
    # data files
    r"\.json(?:\?|$)",
    r"\.xml(?:\?|$)",
    r"\.csv(?:\?|$)",
]

# Secret patterns as (id, text before the value, value). Matched without case;
# values under 20 characters do not count.
SECRET_PATTERNS = [
    ("api_key", r"api[_-]?key[\"']?\s*[:=]\s*[\"']?", r"[a-zA-Z0-9\-_]{20,}"),
    ("apikey", r"apikey[\"']?\s*[:=]\s*[\"']?", r"[a-zA-Z0-9\-_]{20,}"),
    ("access_token", r"access[_-]?token[\"']?\s*[:=]\s*[\"']?", r"[a-zA-Z0-9\-_]{20,}"),
    ("auth_token", r"auth[_-]?token[\"']?\s*[:=]\s*[\"']?", r"[a-zA-Z0-9\-_]{20,}"),
    ("bearer", r"bearer[\"']?\s*[:=]\s*[\"']?", r"[a-zA-Z0-9\-_]{20,}"),
    ("token", r"token[\"']?\s*[:=]\s*[\"']?", r"[a-zA-Z0-9\-_]{20,}"),
    ("secret_key", r"secret[_-]?key[\"']?\s*[:=]\s*[\"']?", r"[a-zA-Z0-9\-_]{20,}"),
    ("client_id", r"client[_-]?id[\"']?\s*[:=]\s*[\"']?", r"[a-zA-Z0-9\-_]{20,}"),
    ("client_secret", r"client[_-]?secret[\"']?\s*[:=]\s*[\"']?", r"[a-zA-Z0-9\-_]{20,}"),
    ("private_key", r"private[_-]?key[\"']?\s*[:=]\s*[\"']?", r"[a-zA-Z0-9\-_]{20,}"),
    ("authorization_header", r"[\"']Authorization[\"']\s*:\s*[\"']Bearer\s+", r"[a-zA-Z0-9\-_.]{20,}"),
    ("x_api_key_header", r"[\"']X-API-Key[\"']\s*:\s*[\"']", r"[a-zA-Z0-9\-_]{20,}"),
    ("x_auth_token_header", r"[\"']X-Auth-Token[\"']\s*:\s*[\"']", r"[a-zA-Z0-9\-_]{20,}"),
    ("openai", r"openai[_-]?key[\"']?\s*[:=]\s*[\"']?", r"sk-[a-zA-Z0-9]{48,56}"),
    ("google", r"google[_-]?key[\"']?\s*[:=]\s*[\"']?", r"AIza[a-zA-Z0-9\-_]{30,40}"),
    ("anthropic", r"anthropic[_-]?key[\"']?\s*[:=]\s*[\"']?", r"sk-ant-[a-zA-Z0-9\-_]{90,100}"),
    ("aws", r"aws[_-]?key[\"']?\s*[:=]\s*[\"']?", r"AKIA[a-zA-Z0-9]{16,20}"),
    ("azure", r"azure[_-]?key[\"']?\s*[:=]\s*[\"']?", r"[a-zA-Z0-9\-_]{32,}"),
    ("stripe", r"stripe[_-]?key[\"']?\s*[:=]\s*[\"']?", r"[sp]k_[a-zA-Z0-9]{24,40}"),
    ("twilio", r"twilio[_-]?key[\"']?\s*[:=]\s*[\"']?", r"SK[a-zA-Z0-9]{32}"),
    ("github", r"github[_-]?token[\"']?\s*[:=]\s*[\"']?", r"gh[po]_[a-zA-Z0-9]{36,40}"),
    ("slack", r"slack[_-]?token[\"']?\s*[:=]\s*[\"']?", r"xox[bp]-[a-zA-Z0-9\-]{40,100}"),
    ("sendgrid", r"sendgrid[_-]?key[\"']?\s*[:=]\s*[\"']?", r"SG\.[a-zA-Z0-9\-_.]{60,70}"),
]

# Content type -> extension.
MIME_EXTENSIONS = {
    "application/pdf": "pdf",
    "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.ms-excel": "xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.ms-powerpoint": "ppt",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "image/jpeg": "jpg",
    "image/png": "png",
    "image/gif": "gif",
    "image/svg+xml": "svg",
    "image/webp": "webp",
    "image/avif": "avif",
    "image/heic": "heic",
    "image/heif": "heif",
    "video/mp4": "mp4",
    "video/webm": "webm",
    "video/ogg": "ogv",
    "video/avi": "avi",
    "video/quicktime": "mov",
    "audio/mpeg": "mp3",
    "audio/mp4": "m4a",
    "audio/ogg": "ogg",
    "audio/wav": "wav",
    "audio/flac": "flac",
    "audio/opus": "opus",
    "application/zip": "zip",
    "application/x-rar-compressed": "rar",
    "application/x-7z-compressed": "7z",
    "application/gzip": "gz",
    "application/x-tar": "tar",
    "text/plain": "txt",
    "text/html": "html",
    "text/css": "css",
    "application/json": "json",
    "application/javascript": "js",
    "application/xml": "xml",
    "text/xml": "xml",
    "font/ttf": "ttf",
    "font/otf": "otf",
    "font/woff": "woff",
    "font/woff2": "woff2",
}
# application/octet-stream has no extension of its own; these path parts make it a file.
OCTET_STREAM_PATHS = ("/download", "/file", "/attachment")

# Extensions by category.
EXTENSION_CATEGORIES = {
    "documents": [
        "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "rtf", "txt", "csv", "env",
    ],
    "images": [
        "jpg", "jpeg", "png", "gif", "bmp", "svg", "webp", "ico", "tiff", "tif", "avif", "heic", "heif",
        "raw", "cr2", "nef", "arw", "dng", "orf",
    ],
    "video": [
        "mp4", "avi", "mov", "wmv", "flv", "webm", "mkv", "mpg", "mpeg", "m4v", "3gp", "ogv", "mts", "m2ts",
        "f4v", "f4p", "f4a", "f4b",
    ],
    "audio": [
        "mp3", "wav", "flac", "aac", "ogg", "wma", "m4a", "opus", "aiff", "au", "ra", "ape", "ac3", "dts",
        "amr", "gsm",
    ],
    "archives": [
        "zip", "rar", "7z", "tar", "gz", "bz2", "xz", "lz", "lzma", "zst", "deb", "rpm", "dmg", "iso", "cab",
        "arj", "lzh", "lha",
    ],
    "code": [
        "js", "css", "json", "xml", "yaml", "yml", "ini", "conf", "config", "py", "php", "java", "cpp", "c",
        "h", "cs", "rb", "go", "rs", "swift", "kt", "scala", "clj", "hs", "ml", "fs", "elm", "dart", "lua",
        "r",
    ],
    "data": [
        "sql", "db", "sqlite", "mdb", "accdb", "dbf", "tsv", "parquet",
    ],
    "system": [
        "log", "bak", "backup", "old", "temp", "tmp", "cache", "swp", "lock",
    ],
    "web": [
        "html", "htm", "asp", "aspx", "jsp", "do", "action", "ejs", "hbs", "mustache", "twig", "jade", "pug",
    ],
    "fonts": [
        "ttf", "otf", "woff", "woff2", "eot",
    ],
    "3d": [
        "obj", "fbx", "dae", "3ds", "blend", "stl", "ply", "gltf", "glb",
    ],
    "scientific": [
        "nc", "hdf", "hdf5", "mat", "rdata", "pickle", "pkl", "joblib",
    ],
    "other": [
        "exe", "dll", "so", "dylib", "app", "pkg", "msi",
    ],
}

# Marks of client-side rendering.
FRAMEWORK_NAMES = [
    "react", "vue", "angular", "ember", "backbone", "next.js", "nuxt", "gatsby", "svelte", "alpine",
    "htmx", "stimulus", "turbo", "webpack", "vite",
]
APP_ROOT_IDS = ["app", "root", "__next", "__nuxt"]
HYDRATION_MARKS = [
    "data-reactid", "data-react-checksum", "data-server-rendered", "__NEXT_DATA__", "__NUXT__", "ng-version",
    "v-cloak",
]
GENERATOR_NAMES = ["react", "vue", "angular", "next", "nuxt"]

# Phrases of challenge pages, and those seen only by a browser check.
CHALLENGE_PHRASES = [
    "cloudflare", "please wait", "checking your browser", "ddos protection", "enable javascript",
    "verify you are human", "captcha", "recaptcha", "hcaptcha", "just a moment",
]
BROWSER_CHECK_PHRASES = ["not a robot", "verify", "protection", "click allow"]

# Words in a URL and patterns in lower-cased markup that point to script-built pages.
DYNAMIC_URL_WORDS = [
    "react", "vue", "angular", "spa", "single-page", "javascript", "js", "ajax", "dynamic",
]
DYNAMIC_PATTERNS = [
    r"<script[^>]*src=[^>]*>",
    r"<div[^>]*id=[\"'][^\"']*react[^\"']*[\"']",
    r"<div[^>]*data-react",
    r"window\.__INITIAL_STATE__",
    r"window\.__REDUX_STATE__",
    r"angular\.module",
    r"vue\.createApp",
    r"new Vue",
    r"\.getElementById.*\.innerHTML\s*=",
    r"fetch\s*\(",
    r"\$\.ajax",
    r"XMLHttpRequest",
    r"document\.write",
    r"setTimeout.*function",
    r"addEventListener.*load",
    r"onload\s*=",
    r"<noscript>",
    r"<!--\[if[^>]*IE.*\]>",
]

# Content types kept as binary records.
BINARY_TYPES = [
    "image/", "application/pdf", "application/zip", "video/", "audio/", "application/octet-stream",
]

# Words that mark a download.
DOWNLOAD_WORDS = ["download", "save", "export", "get", "fetch"]

# Status codes worth another try.
RETRYABLE_STATUS = [408, 425, 429, 500, 502, 503, 504]

# Encodings tried in order when nothing declares one.
FALLBACK_ENCODINGS = [
    "utf-8", "utf-8-sig", "cp1252", "windows-1252", "iso-8859-1", "latin-1", "cp1251", "windows-1251",
    "cp1250", "windows-1250", "iso-8859-2", "iso-8859-15", "gb2312", "gbk", "gb18030", "big5", "cp950",
    "shift_jis", "cp932", "euc-jp", "iso-2022-jp", "euc-kr", "cp949", "iso-8859-5", "iso-8859-7",
    "iso-8859-8", "iso-8859-9", "utf-16", "utf-16le", "utf-16be", "utf-32", "utf-32le", "utf-32be", "ascii",
]
