"""Fixed patterns and values of the formats that this library reads and writes.

Java's dot stops at more characters than a line feed; (?d) makes it stop there only.
"""

# Log line formats.
TIMESTAMP = r"(?d)^\[(\d{2}:\d{2}:\d{2})\]"
THREAD = r"(?d)\[T(\d+)\]"
START = r"(?d)^\[\d{2}:\d{2}:\d{2}\]\[T\d+\]\s*▶\s*START\s+(.+)$"
DONE = r"(?d)^\[\d{2}:\d{2}:\d{2}\]\[T\d+\]\s*✓\s*\[(\d+\.?\d*)s\]\s*DONE(?:\s+\[IMG_TYPE:\s*([^\]]+)\])?"
FAILED = r"(?d)^\[\d{2}:\d{2}:\d{2}\]\[T\d+\].*?✗\s*\[(\d+\.?\d*)s\]\s*FAILED\s*(.+)$"
PREFIX = r"(?d)^\[\d{2}:\d{2}:\d{2}\]\[T\d+\]\s*"
SPLIT_THREAD = r"(?d)^\[.*?\]\[(T\d+)\]"
HEADER = r"(?di)\[\d+/\d+\]\s+(\S+\.(?:jpg|jpeg|png|gif|webp))"
TOOL_CALL, WARNING, ERROR = "[ToolCall]", "[WARNING]", "[ERROR]"

# Error classes, the first that matches wins, upper and lower case alike.
ERROR_CLASSES = (
    ("connection_timeout", "connection|timeout|timed out"),
    ("rate_limit", "429|rate.*limit"),
    ("img_missing", "IMG_MISSING"),
    ("img_error", "IMG_ERROR"),
    ("api_error", "IMG_API_ERROR|IMG_PROCESS_ERROR"),
    ("worker_fatal", "IMG_WORKER_FATAL"),
    ("empty_response", "IMG_EMPTY_RESPONSE"),
    ("invalid_format", "IMG_INVALID_FORMAT"),
)

# Markdown references, part names, file formats, results.
IMAGE_REF = r"(?d)!\[.*?\]\((images/.+?\.(?:jpg|jpeg|png|gif|webp))\)"
PART_NAME = r"(?d)^(.+?)_part(\d+)$"
PART_SEPARATOR = "\n\n---\n\n"
SUPPORTED = ("pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "html", "png", "jpg", "jpeg", "jp2", "webp", "gif", "bmp")
TYPE_TAG, RESULT_TAG = "[IMG_TYPE:", "[IMG_"
INVALID_RESPONSE, INVALID_FORMAT, EMPTY_RESPONSE = "__INVALID_RESPONSE__", "[IMG_INVALID_FORMAT]", "[IMG_EMPTY_RESPONSE]"
STATE_LABELS = (("pending", "排队中"), ("running", "解析中"), ("converting", "格式转换中"), ("waiting-file", "等待文件上传"))
STEP_LABELS = (("split", "split files"), ("parse", "parse documents"), ("organize", "organize results"), ("describe", "describe images"), ("analyze", "analyze logs"))
RATE_LIMITED, NO_CONNECTION = "[IMG_RATE_LIMIT_EXCEEDED]", "[IMG_CONNECTION_TIMEOUT]"
