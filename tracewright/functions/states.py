"""Diffs and redaction of JSON states, and assembly of event content."""
from __future__ import annotations

import ipaddress
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

from tracewright.config import DENY_KEYS, DENY_SUFFIXES, INGEST, REDACTED_VALUE, STORED, Settings
from tracewright.functions.canon import Rejected, StrictJson, dump
from tracewright.schemas import CHANGE

_ABSENT = object()


def pointer_step(name: str) -> str:
    return "/" + name.replace("~", "~0").replace("/", "~1")


def _steps(path: str) -> list[str]:
    return [s.replace("~1", "/").replace("~0", "~") for s in path.split("/")[1:]]


def diff(before, after) -> list[dict]:
    """Changes between two trees, sorted by the bytes of their paths.

    Objects are compared member by member, everything else as a whole. A null
    root next to an object counts as an empty object.
    """
    if before is None and isinstance(after, dict):
        before = {}
    elif after is None and isinstance(before, dict):
        after = {}
    found, todo = [], [("", before, after)]
    while todo:
        path, old, new = todo.pop()
        if isinstance(old, dict) and isinstance(new, dict):
            todo += [(path + pointer_step(n), old.get(n, _ABSENT), new.get(n, _ABSENT)) for n in {**old, **new}]
        elif old is _ABSENT:
            found.append({"op": "add", "path": path, "to": new})
        elif new is _ABSENT:
            found.append({"op": "remove", "path": path, "from": old})
        elif dump(old) != dump(new):
            found.append({"op": "replace", "path": path, "from": old, "to": new})
    return sorted(found, key=lambda change: change["path"].encode())


def mask_text(text: str) -> str:
    return "*" * len(text) if len(text) <= 8 else "*" * (len(text) - 4) + text[-4:]


@lru_cache(maxsize=65536)
def _bare(name: str) -> str:
    # Letters and decimal digits only (str.isdigit would also take superscripts).
    return "".join(ch for ch in name.lower() if ch.isalpha() or ch.isdecimal())


class Redaction:
    def __init__(self, settings: Settings):
        defaults = () if settings.disable_defaults else DENY_KEYS
        self.names = {*defaults, *map(_bare, settings.redact_keys)}
        self.endings = () if settings.disable_defaults else DENY_SUFFIXES
        self.paths = set(settings.redact_paths)
        self.mode = settings.redact_mode
        self.sensitive = lru_cache(maxsize=65536)(self._sensitive)

    def _sensitive(self, name: str) -> bool:
        bare = _bare(name)
        return bool(bare) and (bare in self.names or bare.endswith(self.endings or ("\0",)))

    def hidden(self, value):
        return mask_text(value) if self.mode == "mask" and isinstance(value, str) else REDACTED_VALUE

    def state(self, path: str, value, noted: set):
        """The value without its sensitive parts; their pointers go to ``noted``."""
        if path in self.paths:
            noted.add(path)
            return self.hidden(value)
        if isinstance(value, list):
            return [self.state(f"{path}/{i}", item, noted) for i, item in enumerate(value)]
        if not isinstance(value, dict):
            return value
        kept = {}
        for name, item in value.items():
            child = path + pointer_step(name)
            if self.sensitive(name) or child in self.paths:
                noted.add(child)
                if self.mode != "remove":
                    kept[name] = self.hidden(item)
            else:
                kept[name] = self.state(child, item, noted)
        return kept

    def change(self, change: dict, noted: set) -> dict:
        """A change with sensitive values replaced; they are never removed."""
        out = {"op": change["op"], "path": change["path"]}
        sides = {"from": "/before" + change["path"], "to": "/after" + change["path"]}
        whole = any(map(self.sensitive, _steps(change["path"]))) or any(map(self._covered, sides.values()))
        for side in ("from", "to"):
            if side in change:
                if whole:
                    noted.add(sides[side])
                    out[side] = self.hidden(change[side])
                else:
                    out[side] = self.state(sides[side], change[side], noted)
        return out

    def _covered(self, path: str) -> bool:
        parts = path.split("/")
        return any("/".join(parts[:n]) in self.paths for n in range(2, len(parts) + 1))


def plain_ip(text: str) -> str | None:
    """Normal form of an address, IPv4-mapped IPv6 as IPv4; None if it is none."""
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return None
    return str(getattr(address, "ipv4_mapped", None) or address)


def assemble(event: dict, occurred_at: str | None, settings: Settings, redaction: Redaction) -> dict:
    """Content tree of a validated event: absent members stay absent, nulls stay null."""
    noted: set[str] = set()
    content = {"action": event["action"]}
    for party in ("actor", "resource"):
        if party in event:
            content[party] = {k: v for k, v in event[party].items() if k != "displayName" or v != ""}
    diff_only = settings.retain_states == "diff"
    sides = sum(s in event for s in ("before", "after"))
    if sides == 2 or (diff_only and sides):
        changes = diff(event.get("before"), event.get("after"))
        if changes or diff_only:
            content["changes"] = [redaction.change(c, noted) for c in changes]
    for member in ("data", "metadata") if diff_only else ("before", "after", "data", "metadata"):
        if member in event:
            content[member] = redaction.state("/" + member, event[member], noted)
    context = {k: v for k, v in event.get("context", {}).items() if v != ""}
    if "sourceIp" in context:
        context["sourceIp"] = plain_ip(context["sourceIp"])
    if context:
        content["context"] = context
    if occurred_at:
        content["occurredAt"] = occurred_at
    if noted:
        content["redactions"] = sorted(noted, key=str.encode)
    return content


def _per_row(values, make):
    return [None if v is None else make(v) for v in values]


def source_ip(col: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(_per_row(texts, plain_ip), dtype=object)

    return run(col)


def json_diff(before: Column, after: Column) -> Column:
    """array<struct<op,path,from,to>>; values are canonical JSON texts.

    A SQL null stands for JSON null, which the diff treats as an empty object
    next to an object.
    """

    @F.pandas_udf("array<struct<op:string,path:string,`from`:string,`to`:string>>")
    def run(olds: pd.Series, news: pd.Series) -> pd.Series:
        reader = StrictJson(STORED)

        def tree(raw):
            return None if raw is None else reader.parse(bytes(raw))[0]

        out = []
        for old, new in zip(olds, news):
            try:
                changes = diff(tree(old), tree(new))
            except Rejected:
                out.append(None)
                continue
            out.append([{"op": c["op"], "path": c["path"],
                         "from": dump(c["from"]) if "from" in c else None,
                         "to": dump(c["to"]) if "to" in c else None} for c in changes])
        return pd.Series(out, dtype=object)

    return run(before.cast("binary"), after.cast("binary"))


def redact(col: Column, member: str, settings: Settings) -> Column:
    """struct(json, redacted): a state below /member without its sensitive parts."""

    @F.pandas_udf("json string, redacted array<string>")
    def run(raws: pd.Series) -> pd.DataFrame:
        reader, redaction = StrictJson(STORED), Redaction(settings)
        texts, pointers = [], []
        for raw in raws:
            text = noted = None
            if raw is not None:
                try:
                    noted = set()
                    text = dump(redaction.state("/" + member, reader.parse(bytes(raw))[0], noted))
                except Rejected:
                    text = noted = None
            texts.append(text)
            pointers.append(None if noted is None else sorted(noted, key=str.encode))
        return pd.DataFrame({"json": pd.Series(texts, dtype=object), "redacted": pd.Series(pointers, dtype=object)})

    return run(col.cast("binary"))


def redact_changes(changes: Column, settings: Settings) -> Column:
    """struct(changes, redacted) for an array as made by ``json_diff``."""

    @F.pandas_udf("changes array<struct<op:string,path:string,`from`:string,`to`:string>>, redacted array<string>")
    def run(rows: pd.Series) -> pd.DataFrame:
        reader, redaction = StrictJson(STORED), Redaction(settings)
        lists, pointers = [], []
        for row in rows:
            if row is None:
                lists.append(None)
                pointers.append(None)
                continue
            noted: set[str] = set()
            done = []
            for change in row:
                tree = {k: reader.parse(change[k].encode())[0] if k in ("from", "to") else change[k]
                        for k in ("op", "path", "from", "to") if change[k] is not None}
                kept = redaction.change(tree, noted)
                done.append({"op": kept["op"], "path": kept["path"],
                             "from": dump(kept["from"]) if "from" in kept else None,
                             "to": dump(kept["to"]) if "to" in kept else None})
            lists.append(done)
            pointers.append(sorted(noted, key=str.encode))
        return pd.DataFrame({"changes": pd.Series(lists, dtype=object), "redacted": pd.Series(pointers, dtype=object)})

    return run(changes)


def mask(col: Column) -> Column:
    """More than eight characters keep the last four; the rest becomes asterisks."""
    size = F.char_length(col)
    return F.when(size > 8, F.concat(F.repeat(F.lit("*"), size - 4), F.right(col, F.lit(4)))) \
        .otherwise(F.repeat(F.lit("*"), size))


# The members of a submitted event.
EVENT_MEMBERS = ["stream", "actor", "action", "resource", "before", "after", "data", "metadata", "context", "occurredAt"]
PARTY_MEMBERS = ["type", "id", "displayName"]
CONTEXT_MEMBERS = {"requestId": 128, "traceId": 128, "sessionId": 128, "userAgent": 512, "sourceIp": 64}
REQUEST_OBJECTS = ["actor", "resource", "metadata", "context"]
REQUEST_TEXTS = ["stream", "action", "occurredAt", *[f"{p}.{m}" for p in ("actor", "resource") for m in PARTY_MEMBERS],
                 *[f"context.{m}" for m in CONTEXT_MEMBERS]]
REQUEST_PATHS = [*REQUEST_OBJECTS, *REQUEST_TEXTS]
_KNOWN = {"actor": PARTY_MEMBERS, "resource": PARTY_MEMBERS, "context": list(CONTEXT_MEMBERS)}
_SPLIT = [path.rpartition(".")[::2] for path in REQUEST_PATHS]


def _members(tree: dict):
    """(kind letters, texts, unknown names) of a parsed request: o object, s text, x other, - absent."""
    letters, texts = [], []
    for owner, name in _SPLIT:
        node = tree.get(owner) if owner else tree
        value = node.get(name, _ABSENT) if isinstance(node, dict) else _ABSENT
        letters.append("-" if value is _ABSENT else "s" if isinstance(value, str) else "o" if isinstance(value, dict) else "x")
        texts.append(value if isinstance(value, str) else None)
    unknown = sorted(tree.keys() - EVENT_MEMBERS)
    for owner, known in _KNOWN.items():
        if isinstance(tree.get(owner), dict):
            unknown += [f"{owner}.{name}" for name in sorted(tree[owner].keys() - known)]
    return "".join(letters), texts[len(REQUEST_OBJECTS):], unknown


def read_request(body: Column) -> Column:
    """One strict parse of a submitted event: canonical text or error, the kinds
    and texts of the members the rules look at, names no rule knows, and the
    normalized source address."""
    fields = [path.replace(".", "_") for path in REQUEST_TEXTS]
    schema = "canonical string, error string, kinds string, unknown array<string>, ip string, " \
        + ", ".join(f"{name} string" for name in fields)

    @F.pandas_udf(schema)
    def run(bodies: pd.Series) -> pd.DataFrame:
        reader = StrictJson(INGEST)
        rows = []
        for body in bodies:
            canonical = error = kinds = ip = None
            texts, unknown = [None] * len(fields), []
            if body is not None:
                try:
                    tree, plain = reader.parse(bytes(body))
                    canonical = reader.encode(tree, plain)
                    if isinstance(tree, dict):
                        kinds, texts, unknown = _members(tree)
                        ip = plain_ip(texts[-1]) if texts[-1] else None
                except Rejected as err:
                    error = str(err)
            rows.append((canonical, error, kinds, unknown, ip, *texts))
        names = ["canonical", "error", "kinds", "unknown", "ip", *fields]
        return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(names, zip(*rows))}, columns=names)

    return run(body.cast("binary"))


def content_text(request: Column, occurred_at: Column, settings: Settings) -> Column:
    """Canonical content of an event (canonical request JSON); null if it has no usable shape."""

    @F.pandas_udf("string")
    def run(events: pd.Series, times: pd.Series) -> pd.Series:
        reader, redaction = StrictJson(INGEST), Redaction(settings)
        out = []
        for raw, time in zip(events, times):
            try:
                tree, plain = reader.parse(raw.encode())
                out.append(reader.encode(assemble(tree, time, settings, redaction), plain))
            except (Rejected, AttributeError, KeyError, TypeError):
                out.append(None)        # validation reports what is wrong with it
        return pd.Series(out, dtype=object)

    return run(request, occurred_at)


__all__ = ["CHANGE", "Redaction", "assemble", "content_text", "diff", "json_diff", "mask", "mask_text", "plain_ip",
           "pointer_step", "read_request", "redact", "redact_changes", "source_ip"]
