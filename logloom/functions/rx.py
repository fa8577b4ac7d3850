"""Regular expressions that mean the same in Spark (java.util.regex), Python (re) and RE2.

Patterns are written once, in the common subset with ASCII word bounds. java() rewrites what Java reads otherwise: a
bound next to non-ASCII letters, and an end of text that would also stand before a last newline.
"""

from __future__ import annotations

import re

# Patterns and words that results depend on.
GOTEST_MARKER = r"^(\s*)===\s+(RUN|PAUSE|CONT|NAME)\s+(.+)$"
GOTEST_RESULT = r"^(\s*)---\s+(PASS|FAIL|SKIP):\s+(.+?)\s+\((.+?)\)$"
GOTEST_BARE = r"^(PASS|FAIL)$"
GOTEST_PACKAGE_OK = r"^ok\s+\S+\s+[\d.]+s"
GOTEST_PACKAGE_FAIL = r"^FAIL\s+\S+\s+[\d.]+s"
DIFF_OLD = r"---\s+\S+"
DIFF_NEW = r"^(\s*)\+\+\+\s+\S+"
DIFF_HUNK = r"^(\s*)@@\s"
GOTEST_DASH = r"^(\s*)---\s+(PASS|FAIL|SKIP):"
ERROR_PREFIX = r"(?i)^(\s*(?:\[?))(Error|ERROR|FATAL)([:\]\s])"
WARN_PREFIX = r"(?i)^(\s*(?:\[?))(Warning|WARN|WARNING)([:\]\s])"
NGINX_LEVEL = r"\[(debug|info|notice|warn|error|crit|alert|emerg)\]"
KLOG_PREFIX = r"^([IWEFD])(\d{4}\s+\d{2}:\d{2}:\d{2}\.\d+)"
NGINX_DATETIME = r"\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}"
DATETIME = r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:\s+[+-]\d{4})?(?:\s+[A-Z]{2,5})?"
CLOCK = r"(?:^|[\s|])(\d{2}:\d{2}:\d{2})(?:[\s|,.]|$)"
NGINX_FIELD = r"\b(?:client|server|upstream|host|request|referrer|subrequest):[\s\"]"
PROXY_PROTOCOL = r"while reading PROXY protocol"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
FAILED_STEP = r"(?i)\bfailed in step\s+\S+"
EVENT_SEVERITY = r"(\s{2,})(Normal|Warning)(\s{2,})"
SOURCE_REF = r"\b([\w./-]+\.(?:go|py|js|ts|tsx|jsx|rs|java|rb|c|cpp|h|hpp|cs|swift|kt|scala|sh|bash|zsh|yaml|yml|toml|json|xml|html|css|scss|sql|proto|ex|exs|hs|lua|r|pl|pm|php)):(\d+)\b"
K8S_GROUPED = r"\b([a-z]+(?:\.[a-z][a-z0-9.]*)+)/([a-zA-Z0-9._-]+)\b"
K8S_SIMPLE = r"\b([a-z]+)/([a-zA-Z0-9._-]+)\b"
K8S_KINDS = (
    "pod", "pods", "deployment", "deployments", "service", "services", "svc", "configmap", "configmaps", "cm", "secret", "secrets", "namespace",
    "namespaces", "ns", "node", "nodes", "daemonset", "daemonsets", "ds", "statefulset", "statefulsets", "sts", "replicaset", "replicasets", "rs",
    "job", "jobs", "cronjob", "cronjobs", "cj", "ingress", "ingresses", "ing", "persistentvolume", "pv", "persistentvolumeclaim", "pvc",
    "serviceaccount", "sa", "role", "clusterrole", "rolebinding", "clusterrolebinding", "networkpolicy", "netpol", "customresourcedefinition", "crd",
    "gateway", "gateways",
)
JSON_KEY = r'"[\w]+"\s*:'
SHELL_VAR = r"\$\{[^}]+\}"
FORMAT_PLACEHOLDER = r"\{[%\d]\w*\}"
UNWRAPPED_JSON = r'^\s*"[\w.-]+":\s*[\[{"]'
LEVELS = {
    "error": ("error", "err"),
    "fatal": ("fatal", "panic", "crit", "critical", "alert", "emerg"),
    "warn": ("warn", "warning"),
    "info": ("info", "notice"),
    "debug": ("debug", "trace"),
}
#: Masks of a token in order; None stands for the mixed-run rule of templates.
MASKS = [
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}(?::?\d{2})?)?", "*"),
    (r"\b\d{4}-\d{2}-\d{2}\b", "*"),
    (r"\d{1,2}/[A-Z][a-z]{2}/\d{4}(?::\d{2}:\d{2}:\d{2})?", "*"),
    (r"\b\d{4}/\d{2}/\d{2}\b", "*"),
    (r"https?://[^\s\"]+", "*"),
    (r"Credential=[^\",\s]+", "Credential=*"),
    (r"SignedHeaders=[^\",\s]+", "SignedHeaders=*"),
    (r"Signature=[^\",\s]+", "Signature=*"),
    (r"%7[Bb][0-9a-fA-F-]+%7[Dd]", "*"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "*"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\b", "*"),
    (r"\b\d+#\d+:?", "*"),
    (r"\*\d+", "*"),
    (r"\b\d{1,2}:\d{2}:\d{2}(?:\.\d+)?\b", "*"),
    (r"\b\d{1,2}:\d{2}(?:AM|PM|am|pm)\b", "*"),
    (r"\b[WEI]\d{4}\b", "*"),
    (r"\b[a-zA-Z][a-zA-Z0-9-]*(?:\.[a-zA-Z][a-zA-Z0-9-]*){2,}\b", "*"),
    (r"\b[0-9a-fA-F]{16,}\b", "*"),
    (r"\b[A-Za-z0-9+/=]{16,}\b", None),
    (r"\d+\.\d+", "*"),
    (r"\"/[^\"\s]*\"", '"*"'),
    (r"\"\d+\"", '"*"'),
    (r"\b\d{4,}\b", "*"),
]
PROGRESS_KEYS = [
    "frame", "fps", "bitrate", "total_size", "out_time_us", "out_time_ms", "out_time", "dup_frames", "drop_frames", "speed", "progress",
]
# End of fixed values.

#: CSI and OSC escapes, and two-byte ones. Ours: results on other escapes aren't fixed by anything.
ANSI = "\x1b(?:\\[[0-?]*[ -/]*[@-~]|\\][^\x07\x1b]*(?:\x07|\x1b\\\\)?|[@-Z\\\\-_])"
_W = "[0-9A-Za-z_]"
_BOUND = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def java(pattern: str) -> str:
    """The pattern for Spark's regexp functions."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            out.append(_BOUND if two == r"\b" and not in_class else r" \t\n\f\r" if two == r"\s" and in_class else r"[ \t\n\f\r]" if two == r"\s" else r"[^ \t\n\f\r]" if two == r"\S" and not in_class else two)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class and pattern[i - 1] != "[":
            in_class = False
        elif c == "$" and not in_class:
            c = r"\z"
        elif c == "." and not in_class:
            c = r"[^\n]"
        out.append(c)
        i += 1
    return "".join(out)


def python(pattern: str) -> re.Pattern:
    """The pattern for Python, with ASCII classes and `$` as the end of text only."""
    return re.compile(_spaces(pattern), re.ASCII)


def _spaces(pattern: str) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            out.append((" \\t\\n\\f\\r" if in_class else "[ \\t\\n\\f\\r]") if two == r"\s" else two)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class and pattern[i - 1] != "[":
            in_class = False
        elif c == "$" and not in_class:
            c = r"\Z"
        out.append(c)
        i += 1
    return "".join(out)
