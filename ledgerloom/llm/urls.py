"""URL filters by a path-template tree.

Per host, the segments of a path are a way down a tree. A segment's digits are
a wildcard at once; where a node has many children that hold little of it each,
one wildcard stands for those, however often each is seen. From the
leaves up, branches under one node whose subtrees have the same templates, and
whose labelled shares of bad urls don't differ more than chance allows, are
merged. A template is rejected when its smoothed
labelled share of bad urls reaches ``purity``: it is pulled to its host's share,
that to the share of the same template on other hosts, and that to the overall
one. So a template without labels of its own is judged by its like, unless its
host's labels speak against it. ``support`` labelled urls are needed, its own
or its like's; a template that begins with a wildcard has no like.

Rules come first, the longest that fits; the urls that rules decide are the
labelled ones, and further labels may be given. All of it is grouping and
joining of counts per distinct shape, so a host of any size is no more than
its distinct shapes. The tree has ``depth`` levels: what is behind as many
segments less one stays together as the last one.

A null url, or one without ``://``, has an empty host and path and is judged
like any other. Repeated rows are judged alike. Empty input gives empty output.
Only the id and the url column are read, so further columns don't matter; urls
of any length are read whole, and ties between templates don't arise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerloom.llm.common import cut

#: (kind, host, path): the rules of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ends(expr: str, s: str) -> str:
    return f"right({expr}, {len(s)}) = {_quoted(s)}"


def tree_steps(labelled: bool = False, rules=RULES, engine: str = "spark", depth: int = 6, fan: int = 12, merge_from: int = 5, prior: float = 4.0, support: int = 5, purity: float = 0.8) -> list[tuple[str, str]]:
    """The judgement as named queries, each over those before it ({name}) and {{pages}}."""
    fits = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    when = [(f"(host = {_quoted(h)} OR {_ends('host', '.' + h)}) AND left(path, {len(p)}) = {_quoted(p)}", h + p, kind) for kind, h, p in fits]
    rule = " ".join(f"WHEN {c} THEN {_quoted(name)}" for c, name, _ in when)
    decided = " ".join(f"WHEN rule = {_quoted(name)} THEN {_quoted(kind)}" for _, name, kind in when)
    flag = ", 'g'" if engine == "duckdb" else ""
    number = "('0x' || substr(md5({}), 1, 12))::BIGINT" if engine == "duckdb" else "CAST(conv(substr(md5({}), 1, 12), 16, 10) AS DECIMAL(20, 0))"
    given, join = ("l.bad", "LEFT JOIN (SELECT page_id, max(bad) AS bad FROM {labels} GROUP BY page_id) l ON l.page_id = p.page_id") if labelled else ("CAST(NULL AS INT)", "")
    bad = "CASE WHEN decided = 'block' THEN 1 WHEN decided = 'allow' THEN 0 ELSE given END"
    soft = f"CAST({prior} AS DOUBLE)"
    names = lambda letter, first, last, of="": ", ".join(f"{of}{letter}{i}" for i in range(first, last + 1))
    on = lambda x, y, *columns: " AND ".join(f"{x}.{c} = {y}.{c}" for c in columns)
    node = lambda letter, last: ["host", *[f"{letter}{i}" for i in range(1, last + 1)]]
    # One slash between segments and none before them; the last part is all that is left.
    parts = ", ".join(f"regexp_extract(rest, '^{'[^/]*/' * (i - 1)}({'[^/]*' if i < depth else '(?s:.*)'})', 1) AS s{i}" for i in range(1, depth + 1))
    s, t, b = names("s", 1, depth), names("t", 1, depth), names("b", 1, depth)
    steps = [("judged", f"""SELECT *, {parts} FROM (SELECT *, CASE {decided} END AS decided, regexp_replace(regexp_replace(regexp_replace(path, '/+', '/'{flag}), '^/', ''), '[0-9]+', '#'{flag}) AS rest FROM (SELECT *, CASE {rule} END AS rule FROM (
  SELECT p.page_id, coalesce(translate(regexp_extract(p.url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(p.url, '://[^/?#]*([^?#]*)', 1), '') AS path, {given} AS given FROM {{pages}} p {join}) x) y) z"""),
        ("level0", f"SELECT host, {s}, count(*) AS n, count(bad) AS known, coalesce(sum(bad), 0) AS bad FROM (SELECT *, {bad} AS bad FROM {{judged}}) x GROUP BY host, {s}")]
    for i in range(1, depth + 1):
        keys = node("t", i - 1)
        by = ", ".join(keys)
        # A child is light if it holds no more than 1 / fan of its node's urls; many light ones are one wildcard.
        steps += [
            (f"light{i}", f"""SELECT {', '.join('k.' + c for c in keys)}, k.s{i} FROM (SELECT {by}, s{i}, sum(n) AS n FROM {{level{i - 1}}} GROUP BY {by}, s{i}) k
  JOIN (SELECT {by}, sum(n) AS total FROM {{level{i - 1}}} GROUP BY {by}) a ON {on('k', 'a', *keys)} WHERE k.n * {fan} <= a.total"""),
            (f"level{i}", f"""SELECT x.*, CASE WHEN w.host IS NOT NULL THEN '*' ELSE x.s{i} END AS t{i} FROM {{level{i - 1}}} x LEFT JOIN
  (SELECT l.* FROM {{light{i}}} l JOIN (SELECT {by} FROM {{light{i}}} GROUP BY {by} HAVING count(*) >= {fan}) m ON {on('l', 'm', *keys)}) w ON {on('x', 'w', *keys, f's{i}')}""")]
    steps.append(("templates", f"SELECT host, {t}, sum(known) AS known, sum(bad) AS bad FROM {{level{depth}}} GROUP BY host, {t}"))
    steps.append((f"tree{depth}", f"SELECT *, t{depth} AS b{depth} FROM {{templates}}"))
    # From the leaves up: a subtree goes by how many templates it has and the sum of their hashes.
    for i in range(depth - 1, 0, -1):
        by, own, up = ", ".join(node("t", i)), names("b", i + 1, depth), node("t", i - 1)
        below = " || '/' || ".join(f"b{j}" for j in range(i + 1, depth + 1))
        like = [*up, "leaves", "digest"]
        steps += [
            (f"branches{i}", f"SELECT {by}, count(*) AS leaves, sum({number.format(below)}) AS digest, sum(known) AS known, sum(bad) AS bad FROM (SELECT {by}, {own}, sum(known) AS known, sum(bad) AS bad FROM {{tree{i + 1}}} GROUP BY {by}, {own}) x GROUP BY {by}"),
            (f"tree{i}", f"""SELECT x.*, m.b{i} FROM {{tree{i + 1}}} x JOIN (SELECT {names('t', 1, i, 'c.')}, c.host, CASE WHEN c.known >= {merge_from} AND (c.bad * p.known - p.bad * c.known) * (c.bad * p.known - p.bad * c.known) <= 4 * c.known * p.bad * (p.known - p.bad)
  THEN concat('~', CAST(c.leaves AS VARCHAR(20)), '~', CAST(c.digest AS VARCHAR(40))) ELSE c.t{i} END AS b{i} FROM {{branches{i}}} c LEFT JOIN
  (SELECT {', '.join(like)}, sum(known) AS known, sum(bad) AS bad FROM {{branches{i}}} WHERE known >= {merge_from} GROUP BY {', '.join(like)}) p ON {on('c', 'p', *like)}) m ON {on('x', 'm', *node('t', i))}""")]
    return [*steps,
        ("hosts", "SELECT host, sum(known) AS known, sum(bad) AS bad FROM {templates} GROUP BY host"),
        ("shapes", f"SELECT {t}, sum(known) AS known, sum(bad) AS bad FROM {{templates}} WHERE t1 <> '*' GROUP BY {t}"),
        ("rejected", f"""SELECT l.* FROM (SELECT t.host, {names('b', 1, depth, 't.')}, CAST(sum(t.known) AS DOUBLE) AS known, CAST(sum(t.bad) AS DOUBLE) AS bad,
    CAST(sum(coalesce(s.known - t.known, 0)) AS DOUBLE) AS like_known, CAST(sum(coalesce(s.bad - t.bad, 0)) AS DOUBLE) AS like_bad
    FROM {{tree1}} t LEFT JOIN {{shapes}} s ON {on('t', 's', *node('t', depth)[1:])} GROUP BY t.host, {names('b', 1, depth, 't.')}) l
  JOIN {{hosts}} h ON l.host = h.host WHERE l.known + l.like_known >= {support}
  AND (l.bad + {soft} * (h.bad + {soft} * (l.like_bad + {soft} * (SELECT CAST(coalesce(sum(bad), 0) + 1 AS DOUBLE) / (coalesce(sum(known), 0) + 2) FROM {{hosts}})) / (l.like_known + {soft})) / (h.known + {soft})) / (l.known + {soft}) >= {purity}"""),
        ("refused", f"SELECT DISTINCT x.host, {names('s', 1, depth, 'x.')} FROM {{level{depth}}} x JOIN {{tree1}} t ON {on('x', 't', *node('t', depth))} JOIN {{rejected}} r ON {on('r', 't', *node('b', depth))}"),
        ("verdicts", f"""SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.decided, CASE WHEN f.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
  FROM {{judged}} j LEFT JOIN {{refused}} f ON {on('j', 'f', *node('s', depth))}""")]


#: Steps that later ones read more than once, and small next to the pages; kept, so that plans stay small.
KEPT = ("level", "templates", "tree", "refused")


def judged(pages: DataFrame, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """page_id, host, path, rule, verdict for each url. ``labels``: (page_id, bad 0 or 1); a page with several labels is bad if one says so."""
    frames = {"pages": pages.selectExpr(f"`{id_col}` as page_id", f"`{url_col}` as url")}
    if labels is not None:
        frames["labels"] = labels.select("page_id", "bad")
    for name, query in tree_steps(labels is not None, **options):
        used = {k: v for k, v in frames.items() if "{" + k + "}" in query}
        frames[name] = pages.sparkSession.sql(query, **used)
        if name.startswith(KEPT):
            frames[name] = cut(frames[name])
    return frames["verdicts"]


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.common import table

    return judged(table(spark, sf_dir, "pages"))


def _one_query(steps: list[tuple[str, str]]) -> str:
    plain = lambda q: q.format(**{k: k for k, _ in steps}, pages="pages")
    return "WITH " + ",\n".join(f"{k} AS MATERIALIZED ({plain(q)})" for k, q in steps[:-1]) + "\n" + plain(steps[-1][1])


OP2_SQL = _one_query(tree_steps(engine="duckdb"))
