"""Word lists and patterns that decide results, written with \\b for an ASCII word boundary.

Fixed values: all lists and patterns in this module are given and must stay as they are.
"""

from __future__ import annotations

import re
import re._constants as sre
from functools import lru_cache

SOURCES = ("cloudwatch", "splunk", "grafana", "email")
LEVELS = ("trace", "debug", "info", "warn", "error", "fatal", "unknown")
SEVERITIES = ("info", "low", "medium", "high", "critical")

LEVEL_WORDS = (
    ("fatal", r"(?i)\b(fatal|panic|emerg)\b"),
    ("error", r"(?i)\b(error|err|exception|fail(ed|ure)?)\b"),
    ("warn", r"(?i)\b(warn(ing)?)\b"),
    ("info", r"(?i)\b(info|notice)\b"),
    ("debug", r"(?i)\b(debug)\b"),
    ("trace", r"(?i)\b(trace|verbose)\b"),
)

#: Entity -> (pattern, group that holds the value).
ENTITIES = {
    "ip": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0),
    "uuid": (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", 0),
    "email": (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", 0),
    "url": (r"\bhttps?:\/\/[^\s\"'<>]+", 0),
    "requestId": (r"(?i)\b(?:req(?:uest)?[-_]?id|trace[-_]?id|correlation[-_]?id)[=:\s\"]+([\w-]+)", 1),
    "statusCode": (r"(?i)\b(?:status(?:[-_ ]?code)?|http)[=:\s\"]+(\d{3})\b", 1),
    "errorCode": (r"(?i)\b(?:error[-_ ]?code|errno)[=:\s\"]+([\w-]+)", 1),
    "host": (r"(?i)\b(?:host|hostname|server)[=:\s\"]+([\w.-]+)", 1),
    "service": (r"(?i)\b(?:service|svc|app(?:lication)?)[=:\s\"]+([\w.-]+)", 1),
}
LATENCY = r"(?i)\b(?:latency|duration|took|elapsed|response[-_ ]?time)[=:\s\"]+(\d+(?:\.\d+)?)\s*(ms|s)?\b"
BYTES = r"(?i)\b(?:bytes|size|length)[=:\s\"]+(\d+)\b"
STATUS = ENTITIES["statusCode"][0]
KEY_VALUE = r"(\w[\w.-]*)=(\"[^\"]*\"|'[^']*'|\S+)"

#: Template masking, in this order.
MASKS = (
    (ENTITIES["uuid"][0], "<uuid>"),
    (ENTITIES["ip"][0], "<ip>"),
    (r"(?i)\b0x[0-9a-f]+\b", "<hex>"),
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<ts>"),
    (r"\"[^\"]*\"", "<str>"),
    (r"'[^']*'", "<str>"),
    (r"\b\d+(?:\.\d+)?\b", "<num>"),
    (r"\s+", " "),
)

#: Anomaly categories by message, first match wins.
CATEGORIES = (
    ("timeout", r"(?i)\b(timeout|timed[\s-]?out|deadline exceeded|context deadline|etimedout|read timed out|request timeout|gateway timeout|504)\b"),
    ("connection", r"(?i)\b(connection (refused|reset|closed|failed|error|aborted)|econnrefused|econnreset|epipe|broken pipe|no route to host|network (error|unreachable)|socket hang up)\b"),
    ("dependency", r"(?i)\b(service unavailable|circuit breaker|upstream (error|failed|unavailable)|downstream (error|failed|unavailable)|dependency (failed|unavailable)|host unreachable|backend (error|unavailable)|503)\b"),
    ("auth", r"(?i)\b(unauthorized|forbidden|access denied|permission denied|authentication failed|auth failure|invalid (token|credentials|api[\s-]?key|signature)|expired token|401|403)\b"),
    ("rate_limit", r"(?i)\b(rate[\s-]?limit(ed|ing)?|too many requests|throttl(e|ed|ing)|quota exceeded|429)\b"),
    ("resource", r"(?i)(out\s?of\s?memory|oomkilled|\boom\b|heap (space|dump)|gc overhead|disk (full|space)|no space left|too many open files|connection pool (exhausted|timeout)|cannot allocate|memory (exhausted|leak)|thread pool (exhausted|full))"),
    ("crash", r"(?i)\b(crash(ed|es)?|segfault|segmentation fault|core dump(ed)?|sig(kill|segv|abrt)|\bkilled\b|exited with (code|status)|non[\s-]?zero exit|panic|restart(ing|ed)?|unhealthy|liveness probe failed)\b"),
    ("data_integrity", r"(?i)\b(malformed|invalid (xml|json|message|format|request|payload|schema|field)|parse (error|failure)|parsing (failed|error)|deserializ\w+|unmarshal\w*|schema (validation|error)|validation (failed|error)|corrupt(ed|ion)?|checksum (mismatch|failed))\b"),
    ("exception", r"(?i)(exception|errno|error|\bfailed\b|\bfailure\b|\bfail\b|traceback|stack ?trace|unhandled|uncaught|\bfatal\b|\bpanic\b)"),
)
LATENCY_THRESHOLD_MS = 3000
CORRELATION_ENTITIES = ("requestId", "uuid", "ip", "host", "service")

STARTS_ENTRY = r"^\s*(\d{4}-\d{2}-\d{2}T[\d:.]+Z?\s|\([A-Za-z0-9-]{8,}\)|(START|END|REPORT)\s+RequestId)"
XML_OPENING = r"(?i)<[\w.-]*:?cashMessage[\s>]"
XML_OK = r"(?i)^(OK|SUCCESS|PROCESSED_SUCCESSFULLY|ACCEPTED|COMPLETE|COMPLETED)$"
CALL_OK = r"(?i)^(ok|success(ful)?|processed(_successfully)?|accepted|complete[d]?)$"
HANDLER_ID = r"(?i)correlationID:\s*([A-Za-z0-9._-]+)"
HANDLER_TOKEN = r"(?i)correlationID:\s*[A-Za-z0-9._-]+;?"
HTTP_STATUS = (r"(?i)received response\.\s*status:\s*(\d{3})", r"(?i)method completed with status:\s*(\d{3})")
ID_CORR = r"(?i)(?:correlationID:\s*|X-Correlation-ID\s*[=:]\s*)([A-Za-z0-9._-]+)"
ID_PAREN = r"(?i)^\s*\(([0-9a-f][0-9a-f-]{7,})\)"
ID_REQUEST = r"(?i)(?:x-amzn-RequestId\s*=\s*|RequestId\s*:\s*)([0-9a-f-]{16,})"
ID_LEAD = r"(?i)^\S+\s+([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\b"
ID_TRACE = r"(?i)(1-[0-9a-f]{8}-[0-9a-f]{24})"
RECORD_DONE = r"\b(settled|complete[d]?|success(ful)?|posted|cleared|accepted)\b"
RECORD_FAILED = r"\b(fail(ed)?|reject(ed)?|return(ed)?|cancel(l)?ed|error|unsettled)\b"
#: Directives in the text that describes an application; the group holds the minutes.
TIMEOUT_DIRECTIVE = r"(?i)inactivity timeout(?::|\s+of)?\s+(\d+)\s*minute"
SLA_DIRECTIVE = r"(?i)expected within\s+(\d+)\s*minute"
SECRETS = (
    (r"(?i)bearer\s+[A-Za-z0-9._~+/=-]{16,}", "{BEARER_TOKEN}"),
    (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "{JWT}"),
    (r"(?i)aws_secret_access_key\s*[=:]\s*[A-Za-z0-9/+=]{40}", "{AWS_SECRET_KEY}"),
)
PRIVATE_KEY = r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"

# End of fixed values.

_WORD = "[0-9A-Za-z_]"
_OPENS, _CLOSES = f"(?<!{_WORD})", f"(?!{_WORD})"
_EDGE = f"(?:{_OPENS}(?={_WORD})|(?<={_WORD}){_CLOSES})"
_MARK = 0xE000


def _is_word(op, value) -> bool:
    """Whether a pattern's element for one character takes ASCII word characters only."""
    if op is sre.LITERAL:
        return value < 128 and (chr(value).isalnum() or value == ord("_"))
    if op is sre.RANGE:
        return all(_is_word(sre.LITERAL, x) for x in range(value[0], value[1] + 1))
    if op is sre.CATEGORY:
        return value in (sre.CATEGORY_WORD, sre.CATEGORY_DIGIT)
    return op is sre.IN and all(_is_word(*x) for x in value)


def _meets_word(items: list) -> bool:
    """Whether what the elements match, read in the order given, begins with a word character for certain."""
    for op, value in items:
        step = -1 if getattr(items, "backwards", False) else 1
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, _, inner = value
            if not _meets_word(_Way(inner, step)):
                return False
            if least:
                return True
        elif op is sre.SUBPATTERN:
            return _meets_word(_Way(value[3], step))
        elif op is sre.BRANCH:
            return all(_meets_word(_Way(x, step)) for x in value[1])
        else:
            return _is_word(op, value)
    return False


class _Way(list):
    """A sequence of elements, read forwards or backwards."""

    def __init__(self, items, step: int):
        super().__init__(list(items)[::step])
        self.backwards = step < 0


def _edges(items) -> dict[int, str]:
    """For each marked word boundary of a parsed pattern: the half that is enough where a word character must follow or precede it, else both."""
    items, found = list(items), {}
    for i, (op, value) in enumerate(items):
        if op is sre.LITERAL and value >= _MARK:
            found[value] = _OPENS if _meets_word(_Way(items[i + 1 :], 1)) else _CLOSES if _meets_word(_Way(items[:i], -1)) else _EDGE
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            found |= _edges(value[2])
        elif op is sre.SUBPATTERN:
            found |= _edges(value[3])
        elif op is sre.BRANCH:
            for x in value[1]:
                found |= _edges(x)
    return found


@lru_cache(maxsize=None)
def jvm(pattern: str) -> str:
    r"""The pattern for Spark, whose own \b knows Unicode letters: boundaries between ASCII word characters."""
    parts = pattern.split(r"\b")
    marks = [chr(_MARK + k) for k in range(len(parts) - 1)]
    found = _edges(re._parser.parse("".join(x for pair in zip(parts, [*marks, ""], strict=True) for x in pair)))
    return "".join(x + found.get(ord(m), _EDGE) if m else x for x, m in zip(parts, [*marks, ""], strict=True))
