"""Fixed values that decide which rows come out; everything else is logic.

The patterns are written in Python ``re`` syntax.  ``functions.regex.to_java``
turns them into the Java dialect Spark uses, with the same character classes.
"""

from __future__ import annotations

from typing import NamedTuple


class SettingPattern(NamedTuple):
    """A named setting regex.

    ``needs`` is a literal every match contains and ``words`` lower-case words of
    which every match contains one (in any case): texts without them are not
    scanned.  ``not_after`` lists characters no leftmost match can follow, so
    the scan may skip those positions.  All three only save time.

    ``scan`` finds the same matches with digits before them, in one pass: it goes
    over a run of letters and digits once, where the plain pattern starts anew
    behind every digit of it, which is quadratic in the length of the run.
    """

    name: str
    regex: str
    groups: int
    needs: str | None = None
    words: tuple[str, ...] = ()
    not_after: str | None = None
    scan: str | None = None


# --- fixed values -----------------------------------------------------------

SETTING_PATTERNS = (
    SettingPattern("connection_string", r"""(?i)(connection[_\s]string|conn[_\s]str)[_\s]*=\s*["\']([^"\']+)["\']""", 2, "=", ("conn",)),
    SettingPattern("host", r"""(?i)(hostname|host)[_\s]*=\s*["\']?([^"\'\s,}]+)""", 2, "=", ("host",)),
    SettingPattern("port", r"""(?i)port[_\s]*=\s*["\']?(\d+)""", 1, "=", ("port",)),
    SettingPattern("credentials", r"""(?i)(username|user|password|pwd)[_\s]*=\s*["\']([^"\']+)["\']""", 2, "=", ("user", "password", "pwd")),
    SettingPattern("paths", r"""(?i)(path|directory|dir|folder)[_\s]*=\s*["\']?([^"\'\s,}]+)""", 2, "=", ("path", "dir", "folder")),
    SettingPattern("timeout", r"""(?i)timeout[_\s]*=\s*["\']?(\d+)""", 1, "=", ("timeout",)),
    SettingPattern("url", r"""(?i)(https?://[^\s,}"\']+)""", 1, "://", ("http",)),
    SettingPattern("key_value", r"""([A-Za-z_][A-Za-z0-9_]*)\s*=\s*([^,}\s]+)""", 2, "=", (), "A-Za-z0-9_",
                   r"""[0-9]*+([A-Za-z_][A-Za-z0-9_]*+)\s*=\s*([^,}\s]+)"""),
)

JSON_BLOCK = r"""\{[^{}]*\}"""

YAML_BLOCK = r"""(?m)^\s*[A-Za-z_][A-Za-z0-9_]*:\s*\n(?:\s+[^\n]+\n)+"""

ASSIGNMENT_PATTERNS = (
    r"(?i)config[uration]*\s*=",
    r"(?i)setting[s]*\s*=",
    r"(?i)param[s|eter]*\s*=",
    r"(?i)options?\s*=",
    r"(?i)env[ironment]*\s*=",
    r"(?i)var[iable]*\s*=",
)

PLACEHOLDER_VALUES = ("true", "false", "none", "null", "undefined", "example", "test")
MIN_VALUE_LENGTH = 3
CONTEXT_CHARS = 50

SECTION_KEYWORDS = (
    ("configuration", ("config", "configuration", "settings", "parameters")),
    ("database", ("database", "db", "sql", "nosql")),
    ("api", ("api", "endpoint", "rest", "service")),
    ("security", ("security", "auth", "authentication", "permission")),
)
DEFAULT_SECTION_TYPE = "general"

RELATION_TERMS = ("config", "setting", "parameter", "option")
RELATION_TYPE = "reference"
RELATION_CONFIDENCE = 0.8

CHUNK_SIZE = 2000
CHUNK_OVERLAP = 200
CHUNK_SEPARATORS = ("\n\n", "\n", ".", "!", "?", ";", ",", " ")

SUMMARY_SENTENCE = "Document contains configuration settings and parameters"

RELATED_LIMIT = 3
SIMILARITY_SCORE = 1.0

MERGE_DEFAULTS = ("localhost", "127.0.0.1", "user", "password", "0", "", "[]", "{}")
LOOPBACK_VALUES = ("localhost", "127.0.0.1")

DOC_TYPES = {
    "pdf": "pdf", "docx": "docx", "doc": "docx", "txt": "text", "json": "json",
    "yaml": "yaml", "yml": "yaml", "mp4": "video", "avi": "video", "mov": "video",
    "mkv": "video", "mp3": "audio", "wav": "audio", "m4a": "audio",
}

CFBF_MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
ZIP_MAGIC = b"PK\x03\x04"
WORD_MARKERS = (b"Microsoft Word", b"MSWordDoc", b"Word.Document.")
SNIFF_BYTES = 2048

MIN_IMAGE_SIZE = 50
PDF_FILTER_EXTENSIONS = {
    "/DCTDecode": "jpg", "/FlateDecode": "png", "/JPXDecode": "jp2", "/CCITTFaxDecode": "tiff",
}
DEFAULT_IMAGE_EXTENSION = "png"
DATA_URL_PREFIX = "data:image/jpeg;base64,"

DATABASE_RULE = {"host": "string", "port": "integer", "username": "string", "password": "string"}
SERVER_RULE = {"ip": "string", "uptime": "string"}
PORT_RANGE = (1, 65535)

# What validation reports, with the path between the parts.
UNSUPPORTED_TYPE = "Unsupported type '{}' at "
WRONG_TYPE, WRONG_TYPE_FOUND = "Expected {} at ", ", got "
MISSING_PROPERTY = "Missing required property '{}' at "
INVALID_SCHEMA, NOT_A_SCHEMA = "Invalid schema at ", ": schema must be an object"

SYSTEM_MESSAGE = (
    "You are a configuration extraction assistant. "
    "Your task is to extract configuration values that match the provided schema. "
    "Consider the document structure and related configurations when extracting values."
)
USER_MESSAGE = (
    "Extract configurations from the following text, considering these inputs:\n"
    "Text: {text}\n"
    "Structure Summary: {structure_summary}\n"
    "Related Configs: {related_configs}\n"
    "Document Relationships: {relationships}\n"
    "Schema: {schema}\n"
    "Please provide the extracted configurations in valid JSON format matching the schema."
)

# --- end of fixed values ----------------------------------------------------
