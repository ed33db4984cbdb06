"""Secret scans that link the parts of a credential.

Strong forms are reported wherever they stand. Weak forms (a bare key-like
string, a user or client name, an endpoint) are reported only where parts that
complete one another meet in one scope: parts are joined to the scopes, the
stretches of text between blank lines, as intervals.

All of it is built-in column functions on one row at a time: a pattern's pieces
and matches give the positions, so no text is shuffled. Matches are counted up
in chunks, so that the time grows with their number and not with its square.
Null texts count as empty and have no spans; texts of any length are read whole;
positions are code points, ends exclusive. Repeated rows are judged alike, an
empty table gives no rows. Further columns stay as they are; new ones that
would clash with them get underscores in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import free

#: The strong forms, in the order that breaks ties; fixed values.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: The weak forms: an identifier by its name, a key-like string of 40, an endpoint.
NAMED_ID = r"""(?i)(?:access_key_id|client_id|account_id|user(?:name)?)["']?[\x20\t]*[:=][\x20\t]*["']?[A-Za-z0-9._@-]{3,}"""
BARE_KEY = r"(?<![A-Za-z0-9/+=_-])(?=[A-Za-z/+]*[0-9])(?=[A-Z0-9/+]*[a-z])(?=[a-z0-9/+]*[A-Z])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=_-])"
ENDPOINT = r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqp|s3)://[^\s\"'<>]+"
BLANK_LINES = r"\n(?:[\x20\t\r]*\n)+"
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")

#: Matches that are counted up together.
CHUNK = 256
_SPANS = "array<struct<start:int,rank:int,stop:int,kind:string>>"


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost, non-overlapping matches as (start, rank, stop, kind); those whose group is shorter than ``least`` are dropped.

    The pieces between matches and the matches, laid end to end, are the text.
    """
    regexp = F.lit(pattern)
    whole = F.regexp_extract_all(text, regexp, F.lit(0))
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.transform(whole, F.length).alias("n"),
        (F.transform(F.regexp_extract_all(text, regexp, F.lit(group)), F.length) if group else F.transform(whole, F.length)).alias("g"),
    )
    parts = F.filter(parts, lambda x: x["n"].isNotNull())
    rank = KINDS.index(kind) if kind in KINDS else -1

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + x["n"]
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.lit(kind).alias("kind"))
        return F.struct(stop.alias("at"), F.when(x["g"] >= least, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    # Within a chunk positions are relative to its begin; the chunks' begins are summed up after.
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
    begins = lambda chunks: F.aggregate(
        F.transform(chunks, lambda c: c["at"]), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
    moved = lambda x, by: F.struct((x["start"] + by).alias("start"), x["rank"].alias("rank"), (x["stop"] + by).alias("stop"), x["kind"].alias("kind"))
    chunked = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(p, c * CHUNK + 1, CHUNK), begin, step))
    joined = lambda chunks: F.flatten(F.zip_with(chunks, begins(chunks), lambda c, by: F.transform(c["out"], lambda x: moved(x, by))))
    found = _once(parts, lambda p: _once(chunked(p), joined))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def _running(values: Column) -> Column:
    """The greatest of each value and those before it, a chunk at a time."""
    chunk = lambda c: F.slice(values, c * CHUNK + 1, CHUNK)
    chunks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int"))

    def along(tops: Column) -> Column:
        before = lambda c: F.coalesce(F.array_max(F.slice(tops, 1, c)), F.lit(-1))
        inside = lambda v, low: F.transform(v, lambda _, i: F.greatest(low, F.array_max(F.slice(v, 1, i + 1))))
        return F.flatten(F.transform(chunks, lambda c: _once(F.struct(chunk(c).alias("v"), before(c).alias("low")), lambda x: inside(x["v"], x["low"]))))

    return _once(F.transform(chunks, lambda c: F.array_max(chunk(c))), along)


def latest(probes: Column, key, marks: Column, at, value) -> Column:
    """(span, last) of each span: the greatest value among the marks that aren't after its key, -1 if there is none. One sorted merge of both sides."""
    mark = F.transform(marks, lambda m: F.struct(at(m).alias("key"), F.lit(0).alias("side"), value(m).alias("value"), F.lit(None).cast(_SPANS[6:-1]).alias("span")))
    probe = F.transform(probes, lambda p: F.struct(key(p).alias("key"), F.lit(1).alias("side"), F.lit(-1).alias("value"), p.alias("span")))
    paired = lambda m: F.zip_with(m, _running(F.transform(m, lambda x: x["value"])), lambda x, last: F.struct(x["side"].alias("side"), x["span"].alias("span"), last.alias("last")))
    merged = _once(F.array_sort(F.concat(mark, probe)), lambda m: F.transform(F.filter(paired(m), lambda x: x["side"] == 1), lambda x: F.struct(x["span"].alias("span"), x["last"].alias("last"))))
    return F.when(F.size(probes) > 0, merged).otherwise(F.array().cast(f"array<struct<span:{_SPANS[6:-1]},last:int>>"))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``linked``: arrays of (start, rank, stop, kind), sorted.

    A scope's weak identifiers are reported if it holds a secret, its weak
    keys if it holds an identifier, its endpoints if it holds both.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign, access, hexes, base, ident, key, end, gap, ids, secret, both, link = (free(n, docs) for n in ("assign", "access", "hex", "base", "id", "key", "end", "gap", "ids", "secrets", "both", "linked"))
    # A run of A-Z0-9 or 0-9a-f is as long from its first fitting place on as it gets, so the least length can be asked for at once.
    out = docs.withColumns({
        assign: spans(text, ASSIGN, "assign", 2, LEAST["assign"]),
        access: spans(text, r"AKIA[A-Z0-9]{%d,}" % (LEAST["access"] - 4), "access"),
        hexes: spans(text, r"[0-9a-f]{%d,}" % LEAST["hex"], "hex"),
    })
    out = out.withColumn(base, F.array_sort(F.concat(assign, access, hexes)))
    # A weak span is apart if no strong one that begins before its end reaches over its start.
    met = lambda found: latest(found, lambda w: w["stop"] - 1, F.col(base), lambda b: b["start"], lambda b: b["stop"])
    apart = lambda found: F.transform(F.filter(met(found), lambda x: x["last"] <= x["span"]["start"]), lambda x: x["span"])
    out = out.withColumns({ident: apart(spans(text, NAMED_ID, "id")), key: apart(spans(text, BARE_KEY, "key"))})
    holds = (F.size(ident) + F.size(access) > 0) & (F.size(key) + F.size(assign) + F.size(hexes) > 0)
    none = F.array().cast(_SPANS)
    out = out.withColumns({end: F.when(holds, apart(spans(text, ENDPOINT, "endpoint"))).otherwise(none), gap: F.when(holds, spans(text, BLANK_LINES, "gap")).otherwise(none)})
    # A scope goes by the end of the blank lines before it.
    scoped = lambda *cols: latest(F.concat(*cols), lambda p: p["start"], F.col(gap), lambda g: g["stop"], lambda g: g["stop"])
    scopes = lambda *cols: F.array_distinct(F.transform(scoped(*cols), lambda x: x["last"]))
    out = out.withColumns({ids: F.when(holds, scopes(ident, access)), secret: F.when(holds, scopes(key, assign, hexes))})
    out = out.withColumn(both, F.array_intersect(ids, secret))
    begun = lambda found: latest(found, lambda p: p["start"], F.col(both), lambda b: b, lambda b: b)
    weak = F.concat(ident, key, end)
    # Both lists come in order of starts, so that they can be laid side by side.
    linked = F.transform(F.filter(F.zip_with(scoped(ident, key, end), begun(weak), lambda own, of: F.struct(own["span"].alias("span"), (own["last"] == of["last"]).alias("inside"), F.array_contains(F.col(both), -1).alias("first"), own["last"].alias("last"))),
                                  lambda x: x["inside"] & ((x["last"] >= 0) | x["first"])), lambda x: x["span"])
    out = out.withColumn(link, F.when(holds & (F.size(both) > 0), F.array_sort(linked)).otherwise(none))
    return out.select(*docs.columns, base, link)


def written(found: Column | str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark``; overlapping spans become one. Null texts stay null."""
    base, link = free("base", docs), free("linked", docs)

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(F.array_sort(F.concat(base, link)), begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(F.col(text_col)))))
    kept = [F.when(F.size(base) + F.size(link) > 0, clean).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return scan(docs, text_col).select(*kept)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.common import table

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(written("base"), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "linked"))).alias("spans"))
