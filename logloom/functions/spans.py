"""Styled spans of a line: detectors in order of priority, none over an earlier one's span."""

from __future__ import annotations

from . import rx

_NGINX = {"crit": "error", "alert": "error", "emerg": "error", "error": "error", "warn": "warn", "info": "info", "notice": "info", "debug": "debug"}
_KLOG = {"E": "error", "F": "error", "W": "warn", "I": "info", "D": "debug"}


def likely_resource(ref: str) -> bool:
    kind, dot, group = ref.partition("/")[0].partition(".")
    return bool(dot) and (kind.lower() in rx.K8S_KINDS or group.count(".") >= 2 or (len(group) > 3 and "." not in group))


def _level(m):
    yield m.start(), m.end(), "level-" + _NGINX[m[1]]


def _klog(m):
    yield m.start(1), m.end(1), "level-" + _KLOG[m[1]]
    yield m.start(2), m.end(2), "datetime"


def _all(style: str, group: int = 0, trim: int = 0, unless_after: tuple = (), check=None):
    def f(m):
        if not (unless_after and m.string[: m.start()].endswith(unless_after)) and (check is None or check(m)):
            yield m.start(group), m.end(group) - trim, style

    return f


def _severity(m):
    yield m.start(2), m.end(2), "k8s-event-warning" if m[2] == "Warning" else "k8s-event-normal"


#: (pattern, spans of a match, whether it yields to earlier spans), first come first kept.
DETECTORS = [
    (rx.NGINX_LEVEL, _level, False),
    (rx.KLOG_PREFIX, _klog, False),
    (rx.NGINX_DATETIME, _all("datetime"), True),
    (rx.DATETIME, _all("datetime"), True),
    (rx.CLOCK, _all("timestamp", 1), True),
    (rx.NGINX_FIELD, _all("nginx-field", trim=1), True),
    (rx.PROXY_PROTOCOL, _all("nginx-field"), True),
    (rx.IPV4, _all("ip"), True),
    (rx.FAILED_STEP, _all("failed-step"), True),
    (rx.EVENT_SEVERITY, _severity, True),
    (rx.SOURCE_REF, _all("sourceref", unless_after=("/",)), True),
    (rx.K8S_GROUPED, _all("k8s", unless_after=("/",), check=lambda m: likely_resource(m[0])), True),
    (rx.K8S_SIMPLE, _all("k8s", unless_after=("/",), check=lambda m: m[1] in rx.K8S_KINDS), True),
]
_COMPILED = [(rx.python(p), f, y) for p, f, y in DETECTORS]


def spans(raw: str) -> list[tuple[int, int, str, str]] | None:
    """(start, end, text, style) that cover the line, `plain` between hits; None without a hit. Places in characters."""
    hits: list[tuple[int, int, str]] = []
    for pattern, found, yields in _COMPILED:
        for m in pattern.finditer(raw):
            for lo, hi, style in found(m):
                if not yields or not any(lo < b and hi > a for a, b, _ in hits):
                    hits.append((lo, hi, style))
    if not hits:
        return None
    out, at = [], 0
    for lo, hi, style in sorted(hits, key=lambda h: h[0]):
        if lo >= at:
            out += ([(at, lo, raw[at:lo], "plain")] if lo > at else []) + [(lo, hi, raw[lo:hi], style)]
            at = hi
    return out + ([(at, len(raw), raw[at:], "plain")] if at < len(raw) else [])
