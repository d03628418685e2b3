"""Text, path and file expressions, and patterns prepared on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, from here to SYMBOL_PATTERNS, that have to be what users of such searches have today: extensions by
# language, media type and kind, patterns of listings, error codes with their confidence, declarations that count as symbols.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "md": "markdown", "json": "json", "yml": "yaml", "yaml": "yaml", "sh": "bash"}
MEDIA_TYPES = {"txt": "text/plain", "md": "text/markdown", "html": "text/html", "css": "text/css", "csv": "text/csv", "js": "text/javascript", "json": "application/json", "xml": "application/xml", "pdf": "application/pdf", "zip": "application/zip", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "mp3": "audio/mpeg", "mp4": "video/mp4"}
BINARY_EXTENSIONS = (
    "exe", "dll", "so", "dylib", "bin", "jpg", "jpeg", "png", "gif", "bmp", "webp", "ico", "mp3", "mp4", "avi", "mov", "wmv", "flv", "pdf", "zip", "rar", "tar", "gz", "7z",
    "doc", "docx", "xls", "xlsx", "ppt", "pptx", "wasm", "o", "a", "obj", "lib", "class", "pyc", "pyo", "pyd", "sqlite", "db", "mdb", "accdb", "swf", "fla",
)
# Media types that make a file binary, and extensions beyond those above that have one.
BINARY_MEDIA = r"^(image|audio|video)/|^application/(zip|x-rar-compressed|x-tar|gzip|x-7z-compressed|pdf|vnd\.openxmlformats-officedocument.*|msword|octet-stream)$"
MORE_MEDIA_TYPES = {"tif": "image/tiff", "tiff": "image/tiff", "avif": "image/avif", "heic": "image/heic", "psd": "image/vnd.adobe.photoshop", "wav": "audio/wav", "flac": "audio/x-flac", "ogg": "audio/ogg", "aac": "audio/x-aac", "m4a": "audio/mp4", "mid": "audio/midi", "webm": "video/webm", "mkv": "video/x-matroska", "mpeg": "video/mpeg", "m4v": "video/x-m4v", "deb": "application/octet-stream", "dmg": "application/octet-stream", "iso": "application/octet-stream", "img": "application/octet-stream"}
# Patterns that every listing leaves out, and those that it admits, unless told otherwise.
DEFAULT_EXCLUDES = ("**/build/**", "**/dist/**", "**/node_modules/**", "**/.git/**", "**/*.jpg", "**/*.png", "**/*.gif", "**/*.pdf", "**/*.zip", "**/*.tar", "**/*.gz")
DEFAULT_INCLUDES = (
    "*.txt", "*.js", "*.jsx", "*.ts", "*.tsx", "*.json", "*.yaml", "*.yml", "*.html", "*.htm", "*.css", "*.scss", "*.sass", "*.less", "*.py", "*.java", "*.go", "*.rs", "*.rb", "*.php", "*.sh", "*.bash", "*.zsh",
    "*.md", "*.markdown", "*.xml", "*.svg", "*.csv", "*.toml", "*.ini", "*.cfg", "*.conf", "*.env", "*.ejs", "*.pug", "*.vue", "*.svelte", "*.graphql", "*.gql", "*.proto", "*.kt", "*.kts", "*.swift",
    "*.m", "*.h", "*.c", "*.cpp", "*.hpp", "*.cs", "*.fs", "*.fsx", "*.clj", "*.cljs", "*.cljc", "*.edn", "*.ex", "*.exs", "*.erl", "*.hrl", "*.lua", "*.sql", "*.pl", "*.pm", "*.r", "*.jl", "*.dart", "*.groovy", "*.gradle",
    "*.nim", "*.zig", "*.v", "*.vh", "*.vhd", "*.cl", "*.tex", "*.sty", "*.cls", "*.rst", "*.adoc", "*.asciidoc",
)
# What an error code calls for: confidence and hint. The sentences are part of what callers compare.
HINTS = {
    "ACCESS_DENIED": (0.9, "Path is outside of allowedDirectories. Check the 'path' argument."),
    "VALIDATION_ERROR": (0.8, "Check the required fields and their types in the arguments."),
    "FUZZY_MATCH_FAILED": (0.7, "Try adjusting minSimilarity/maxDistanceRatio or check for whitespace/indentation issues."),
    "BINARY_FILE_ERROR": (0.95, "'edit_file' works only on text files. Use 'write_file' with base64 encoding for binary files."),
    "PARTIAL_MATCH": (0.6, "Found a partial match. Review the diff and correct 'oldText' or parameters."),
    "FILE_NOT_FOUND_MULTI": (0.8, "One or more requested files could not be read. See per-file result details."),
    "UNKNOWN_TOOL": (0.9, "The requested tool does not exist. Use 'list_tools' to see available tools."),
    "DEST_EXISTS": (0.85, "Destination path already exists. Provide a different destination or remove the existing file first."),
    "SRC_MISSING": (0.85, "Source file does not exist. Check the 'source' argument."),
    "UNKNOWN_ERROR": (0.1, "An unexpected error occurred. Check server logs for details."),
}
TEXT_EXTENSIONS = ("txt", "md", "py", "js", "ts", "jsx", "tsx", "json", "html", "css", "xml", "yml", "yaml", "csv", "log", "sh", "sql", "ini", "toml", "java", "c", "h", "cpp", "rs", "go")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")
SYMBOL_PATTERNS = (r"\bdef\s+{}", r"\bclass\s+{}", r"\bfunction\s+{}", r"\bconst\s+{}", r"\blet\s+{}", r"\bvar\s+{}")
TEXT, BINARY, CAVEATS = "text", "binary", "text with caveats"
# Percentages of similarity from which an edit is applied, applied if forced, and reported.
APPLY, NEEDS_FORCE, DIAGNOSE = 98, 85, 60


def similarity(a: Column, b: Column) -> Column:
    """(longer - edit distance) / longer; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise((longer - F.levenshtein(a, b)) / longer)


def similarity_band(percent: Column) -> Column:
    return F.when(percent >= APPLY, "apply").when(percent >= NEEDS_FORCE, "needs force").when(percent >= DIAGNOSE, "diagnose").otherwise("none")


def stripped(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def prepared(text: Column, ignore_case: bool = True, ignore_whitespace: bool = True) -> Column:
    """The form in which texts are compared."""
    out = F.lower(text) if ignore_case else text
    if ignore_whitespace:
        out = F.trim(F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n+", "\n"))
    return out


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower case, without the dot; empty if there is none. A leading dot makes no extension."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def _lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), default)


def language(path: Column) -> Column:
    return _lookup(LANGUAGES, extension(path), F.lit("text"))


def media_type(path: Column, binary: Column) -> Column:
    return _lookup(MEDIA_TYPES, extension(path), F.when(binary, "application/octet-stream").otherwise("text/plain"))


def hint(code: Column) -> Column:
    """struct<confidence,hint> for an error code; one that is not listed is an unknown error."""
    known = {k: F.struct(F.lit(c).alias("confidence"), F.lit(h).alias("hint")) for k, (c, h) in HINTS.items()}
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), v)])
    return F.coalesce(F.element_at(table, code), known["UNKNOWN_ERROR"])


def preview(text: Column, most: int = 80) -> Column:
    """The first characters of a text, with dots behind them if there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def iso_timestamp(text: Column) -> Column:
    """An ISO 8601 text as a timestamp; null where it is none."""
    return F.try_to_timestamp(text)


def file_stamp(ts: Column) -> Column:
    """A timestamp as it stands in file names."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def matched_name(name: Column, suffix: str = "_matched") -> Column:
    """The name with ``suffix`` before its extension."""
    return F.regexp_replace(name, r"^(.*?)(\.[^./]*)?$", "$1" + suffix + "$2")


def result_name(path: Column) -> Column:
    return F.concat(F.lit("result_"), file_name(path))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression over relative paths, case apart: a pattern without a slash matches at any depth."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(p) for p in glob[i + 1 : end].split(",")) + ")", end + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return "(?i)^" + ("" if "/" in glob else "(?:.*/)?") + out + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    return F.lit(False) if not globs else path.rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs))


def line_pattern(pattern: str, regex: bool) -> str | None:
    """A usable regular expression, or None where the search has to be literal."""
    if not regex:
        return None
    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern


def classify(content: Column, path: Column) -> Column:
    """Kind of a file by ordered rules: extension, media type, invalid UTF-8, control bytes in the first 1024, NUL in the first 8192."""
    head = F.substring(content, 1, 1024)
    control = F.regexp_count(F.decode(head, "ISO-8859-1"), F.lit(r"[\x01-\x08\x0B\x0C\x0E-\x1F]"))
    nul = F.contains(F.decode(F.substring(content, 1, 8192), "ISO-8859-1"), F.lit("\x00"))
    size = F.octet_length(head)
    return (
        F.when(extension(path).isin(*BINARY_EXTENSIONS), BINARY)
        .when(_lookup(MEDIA_TYPES | MORE_MEDIA_TYPES, extension(path), F.lit("")).rlike(BINARY_MEDIA), BINARY)
        .when(~F.is_valid_utf8(content.cast("string")), BINARY)
        .when((size > 0) & (control / size > 0.1), BINARY)
        .when(nul, CAVEATS)
        .otherwise(TEXT)
    )


def decoded(content: Column, encoding: str = "auto") -> Column:
    """Text of file content: UTF-8, base64, or whichever fits."""
    text = content.cast("string")
    if encoding == "utf-8":
        return text
    if encoding == "base64":
        return F.base64(content)
    return F.when(F.is_valid_utf8(text), text).otherwise(F.base64(content))
