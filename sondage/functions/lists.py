"""Word lists, extension lists and constants that results depend on."""

from __future__ import annotations

# --- Fixed values: extensions by type name -------------------------------------------------
TYPE_GROUPS = {
    "image": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".svg", ".tiff", ".tif", ".ico", ".heic", ".heif", ".raw"],
    "doc": [".pdf", ".docx", ".doc", ".txt", ".md", ".rtf", ".odt", ".pages", ".tex", ".epub"],
    "video": [".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".mpg", ".mpeg"],
    "audio": [".mp3", ".wav", ".flac", ".aac", ".ogg", ".m4a", ".wma", ".opus"],
    "code": [".go", ".py", ".js", ".ts", ".java", ".c", ".cpp", ".cs", ".rb", ".rs", ".php", ".swift", ".kt", ".sh", ".bat", ".ps1"],
    "sheet": [".xlsx", ".xls", ".csv", ".ods", ".numbers"],
    "ppt": [".pptx", ".ppt", ".odp", ".key"],
    "archive": [".zip", ".tar", ".gz", ".rar", ".7z", ".bz2", ".xz"],
}

# --- Fixed values: plain words that imply a type, and the extensions they imply ------------
HINT_WORDS = {
    "image": ["photo", "photos", "picture", "pictures", "pic", "pics", "screenshot", "screenshots", "image", "images"],
    "video": ["video", "videos", "movie", "movies", "film", "films", "clip", "clips", "recording", "recordings"],
    "audio": ["audio", "music", "song", "songs", "sound", "sounds", "podcast", "podcasts", "track", "tracks"],
    "ppt": ["powerpoint", "presentation", "presentations", "slideshow", "slideshows", "slides"],
    "sheet": ["spreadsheet", "spreadsheets", "excel"],
    "doc": ["document", "documents", "doc", "docs", "report", "reports", "notes", "ebook", "ebooks"],
    "pdf": ["pdf"],
    "archive": ["archive", "archives", "zip", "compressed"],
    "code": ["code", "script", "scripts", "source"],
}
#: Where the hint's extensions differ from those of the type of that name.
HINT_EXTENSIONS = {
    **TYPE_GROUPS,
    "image": [x for x in TYPE_GROUPS["image"] if x not in (".svg", ".ico")],
    "code": [x for x in TYPE_GROUPS["code"] if x not in (".bat", ".ps1")],
    "pdf": [".pdf"],
}

# --- Fixed values: extensions handled by content kind --------------------------------------
IMAGE_SOURCE = [".jpg", ".jpeg", ".jfif", ".pjpeg", ".pjp", ".png", ".gif", ".webp"]
IMAGE_SKIPPED = [".ico", ".cur", ".ani", ".bmp", ".tiff", ".tif", ".heic", ".heif", ".avif"]
TEXT_SOURCE = [".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".txt", ".md", ".html", ".htm"]
PLAIN_TEXT = [".txt", ".md", ".csv", ".json", ".xml", ".html", ".htm", ".go", ".py", ".js", ".ts"]

# --- Fixed values: extensions with a score penalty -----------------------------------------
BINARY = [
    ".class", ".exe", ".dll", ".sys", ".inf", ".ini", ".dat", ".bin", ".obj", ".lib", ".pdb", ".ilk", ".so", ".dylib", ".o", ".a", ".pyc", ".pyo", ".wasm", ".node",
]
CODE = [
    ".go", ".py", ".pyi", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".java", ".kt", ".kts", ".rs", ".c", ".h", ".cc", ".cpp", ".cxx", ".hh", ".hpp",
    ".cs", ".fs", ".fsx", ".vb", ".php", ".rb", ".swift", ".scala", ".sql", ".sh", ".bash", ".zsh", ".ps1", ".psm1", ".bat", ".cmd", ".lua", ".pl", ".r",
    ".dart", ".ex", ".exs", ".erl", ".hrl", ".hs", ".lhs", ".clj", ".cljs", ".vue", ".svelte", ".html", ".htm", ".css", ".scss", ".less", ".proto", ".graphql", ".gql",
]
#: Prefixes of lower-cased paths with forward slashes.
SYSTEM_PREFIXES = ["/usr/lib/", "/usr/share/"]

# --- Fixed values: files and folders that are never indexed --------------------------------
JUNK_NAMES = ["ntuser.dat", "ntuser.dat.log", "ntuser.ini", "desktop.ini", "thumbs.db", "hiberfil.sys", "pagefile.sys", "swapfile.sys", "usrclass.dat"]
JUNK_EXTENSIONS = [".tmp", ".temp", ".log", ".etl", ".dmp", ".mdmp", ".pf", ".sdf", ".db-wal", ".db-shm"]
#: Folders that both the scan and the watcher skip.
SKIPPED_FOLDERS = [
    "appdata", "program files", "program files (x86)", "programdata", "windows", "$windows.~bt", "$windows.~ws", "system volume information", "$recycle.bin",
    "recovery", ".cargo", ".m2", ".gradle", ".nuget", "__pycache__", ".venv", "venv", "env", ".tox", "site-packages", "node_modules", "bower_components",
    "vendor", "coverage", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".terraform", ".serverless", "pods", "carthage", "deriveddata", ".yarn",
    ".pnpm-store", ".turbo", ".vite", ".svelte-kit", ".angular", ".astro", ".bundle", "gems", ".git", ".hg", ".svn", ".vscode", ".idea", ".vs", ".eclipse",
    ".metadata", ".settings", "target", "dist", "build", "out", "bin", "obj", ".next", ".nuxt", ".output", ".cache", ".parcel-cache", ".docker",
    "virtualbox vms", "virtual machines", "vmware", "cache", "caches", "crashreports", "crashpad", "logs", "temp", "tmp", "thumbnailcache", ".android",
    "android", ".ssh", ".gnupg", ".aws", ".azure", ".kube",
]
#: Folders that only the scan skips, and one that only the watcher skips.
SCAN_ONLY = [
    "my games", "electronic arts", "rockstar games", "activision", "ubisoft game launcher", "paradox interactive", "bethesda softworks", "2k games",
    "epic games", "steam", "steamapps", "riot games", "battlenet", "battle.net", "blizzard entertainment", "square enix", "sega", "cd projekt red",
    "music", "videos", "movies", "tv shows",
]
WATCH_ONLY = ["perflogs"]
PRIVATE_NAMES = ["whatsapp.db", "msgstore.db"]
PRIVATE_FOLDER = "/whatsapp/"
MODULE_CACHE = "/go/pkg/mod/"
MAX_CONTENT_BYTES = 100 * 1024 * 1024
#: File attributes of a placeholder whose content is elsewhere.
OFFLINE_BITS = 0x1000 | 0x400000

# --- Fixed values: default weights ---------------------------------------------------------
WEIGHTS = {
    "w_path_fts": 3.0, "w_path_prefix": 1.5, "w_semantic_text": 1.0, "w_semantic_image": 1.1, "w_content_fts": 1.0, "w_filename": 1.0, "w_recency": 0.3,
    "recency_half_life": 30.0, "rrf_k": 60.0, "min_score": 0.15, "rerank_top_n": 8.0, "w_reranker_blend": 0.5, "path_only_cap": 0.12, "use_new_pipeline": 1.0,
}
