"""URL verdicts: listed rules, and path templates rejected by what the rules say of their urls.

For each host its paths form a tree of segments. It is grown from branching to branching: what all
paths of a place have in common is one step, so the number of jobs follows how often paths part, not
how deep they are. A segment becomes a wildcard of its type (number, hexadecimal run, other) where it looks like one, or
where its place in the tree has too many values. The branches that are left at a place are pooled by
the type that most of their next segments have. Those are merged whose next segments are of the
same kinds as often as in their pool, by a chi-squared test, and whose labelled shares do not differ
significantly from it; a branch without labelled urls is so merged by its structure alone.

A template's urls are rejected where the share of blocked ones among its labelled urls is high. At
each level it is smoothed by that of the level above, so a branch without labels has its parent's.
The host's own share counts urls without a rule as not blocked, so that a few listed branches do not
condemn others that are unlike them. Below the host urls without a rule count for nothing: a template
that is built as blocked ones are is taken for one of them. On the shipped pages that blocks 621 of
1,395 urls without a rule, all on hosts whose listed branches are all blocked and whose others are
built alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.llm.common import kept, scratch, stored, table

#: Host suffix and path prefix, longest first, and verdict.
RULES = [
    ("www.example.com", "/en/", "allow"),
    ("example.com", "/en/", "block"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
    ("com", "/", "allow"),
]
#: Distinct values of a position under one parent above which it is a wildcard.
MAX_VALUES = 20
#: Urls of a place below which it is no tree: what follows there is one wildcard.
LEAST_URLS = 2
#: Urls that a parent level counts for when it smooths its child's share.
SMOOTHING = 10.0
#: Smoothed share of blocked urls from which a template is rejected.
PURITY = 0.6
#: Standard errors by which merged branches may differ from their pool.
ALIKE_Z = 3.0


def host_of(url: Column) -> Column:
    """A-Z lower-cased, after the first :// up to /, ?, # or the end; empty without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, prefix, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == suffix) | F.endswith(host, F.lit(f".{suffix}"))) & F.startswith(path, F.lit(prefix))
        rule, verdict = F.when(fits, F.lit(suffix + prefix)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _ending(segment: Column) -> Column:
    return F.regexp_extract(segment, r"\.[A-Za-z]{1,5}$", 0)


def _typed(segment: Column) -> Column:
    """A wildcard for segments that are variable by their looks, with the ending that follows it."""
    number = segment.rlike(r"^[0-9]+(\.[A-Za-z]{1,5})?$")
    hexadecimal = segment.rlike(r"^[0-9a-f-]{8,}(\.[A-Za-z]{1,5})?$") & segment.rlike("[0-9]")
    return F.when(number, F.concat(F.lit("{n}"), _ending(segment))).when(hexadecimal, F.concat(F.lit("{x}"), _ending(segment))).otherwise(segment)


def _kind(segment: Column) -> Column:
    """What a segment is to the one before it: the end, a wildcard, an empty segment, or a word."""
    return F.when(segment.isNull(), "$").when(segment.startswith("{") | (segment == ""), segment).otherwise(F.concat(F.lit("{w}"), _ending(segment)))


def _generalised(rows: DataFrame, max_values: int) -> DataFrame:
    """Rows with the value of segment k: a wildcard where its place has too many."""
    value = F.get("segments", F.col("k"))
    wide = rows.select("node", value.alias("value")).distinct().groupBy("node").agg(F.count("*").alias("values")).where(F.col("values") > max_values).select("node", F.lit(True).alias("wide"))
    general = F.when(F.col("wide") & ~value.startswith("{"), F.concat(F.lit("{w}"), _ending(value))).otherwise(value)
    return rows.join(wide, "node", "left").select(*rows.columns, general.alias("value"))


def _branches(rows: DataFrame, smoothing: float, alike_z: float) -> DataFrame:
    """node, value, branch, urls, own_share: what the values of each place are merged to.

    Counts alone are dealt out, by place, and a place has few values; all windows keep to that.
    """
    word, sums = ~F.col("value").startswith("{"), [F.sum(c).alias(c) for c in ("n", "blocked", "labelled")]
    kinds = rows.groupBy("node", "value", _kind(F.get("segments", F.col("k") + 1)).alias("kind")).agg(*sums, F.max("share").alias("share"))
    kinds = kinds.repartition("node").withColumn("type", F.regexp_replace("kind", r"\..*$", ""))
    kinds = kinds.withColumn("c", F.sum("n").over(W.partitionBy("node", "value", "type")))
    kinds = kinds.withColumn("most", F.when(word, F.max(F.struct("c", "type")).over(W.partitionBy("node", "value"))["type"]))
    pool = W.partitionBy("node", "most")
    kinds = kinds.withColumn("kinds", F.size(F.collect_set("kind").over(pool))).withColumn("pool_n", F.sum("n").over(W.partitionBy("node", "most", "kind")))
    squares = F.sum(F.col("n") * F.col("n") / F.col("pool_n").cast("double")).alias("squares")
    found = kinds.groupBy("node", "value", "most").agg(*sums, F.max("share").alias("share"), F.max("kinds").alias("kinds"), squares)
    for c in ("n", "blocked", "labelled"):
        found = found.withColumn(f"all_{c}", F.sum(c).over(pool))
    free = F.col("kinds") - 1
    same_kinds = F.col("squares") * F.col("all_n") / F.col("n") - F.col("n") <= free + alike_z * F.sqrt(2.0 * free) + 1e-9
    mean = F.try_divide(F.col("all_blocked").cast("double"), F.col("all_labelled"))
    same_share = F.abs(F.try_divide(F.col("blocked").cast("double"), F.col("labelled")) - mean) <= alike_z * F.sqrt(F.try_divide(mean * (1 - mean), F.col("labelled"))) + 1e-9
    found = found.withColumn("alike", word & same_kinds & F.coalesce(same_share, F.lit(True)))
    several = F.count_if("alike").over(pool) > 1
    found = found.withColumn("branch", F.when(F.col("alike") & several, F.concat(F.lit("{m:"), "most", F.lit("}"))).otherwise(F.col("value")))
    own = W.partitionBy("node", "branch")
    share = (F.sum("blocked").over(own) + smoothing * F.col("share")) / (F.sum("labelled").over(own) + smoothing)
    return found.select("node", "value", "branch", F.sum("n").over(own).alias("urls"), share.alias("own_share"))


def _jumped(rows: DataFrame, smoothing: float, least_urls: int) -> DataFrame:
    """The rows as far down as all of their place go together: the same steps as level by level.

    The common begin of all paths of a place is that of the first and the last of them in order. On
    the way nothing can be a wildcard or merge, and the share is smoothed once a level.
    """
    rest = F.slice("segments", F.col("k") + 1, F.greatest(F.size("segments") - F.col("k"), F.lit(0)))
    places = rows.groupBy("node").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "blocked", "labelled")], F.min(rest).alias("low"), F.max(rest).alias("high"))
    parts_at = F.array_position(F.transform(F.arrays_zip("low", "high"), lambda x: x["low"].eqNullSafe(x["high"])), False)
    steps = F.when(F.col("all_n") < least_urls, 0).when(parts_at == 0, F.size("low")).otherwise(parts_at - 1).cast("int")
    out = rows.join(places.select("node", "all_blocked", "all_labelled", steps.alias("steps")), "node")
    share = F.aggregate(F.sequence(F.lit(1), F.col("steps")), F.col("share"), lambda s, _: (F.col("all_blocked") + smoothing * s) / (F.col("all_labelled") + smoothing))
    node = F.concat("node", F.lit("/"), F.array_join(F.slice("segments", F.col("k") + 1, F.col("steps")), "/"))
    moved = F.col("steps") > 0
    return out.select("host", "segments", "n", "blocked", "labelled", F.when(moved, node).otherwise(F.col("node")).alias("node"), F.when(moved, share).otherwise(F.col("share")).alias("share"), (F.col("k") + F.col("steps")).alias("k"))


def _level(rows: DataFrame, turn: int, max_values: int, smoothing: float, alike_z: float) -> DataFrame:
    """The rows one level further down: node goes on to the branch of segment k, share to its share."""
    rows = stored(_generalised(rows, max_values), f"url-values-{turn}")
    out = rows.join(_branches(rows, smoothing, alike_z), ["node", "value"])
    return out.select("host", "segments", "n", "blocked", "labelled", F.concat("node", F.lit("/"), "branch").alias("node"), F.col("own_share").alias("share"), (F.col("k") + 1).alias("k"), "urls")


def templates(urls: DataFrame, max_values: int = MAX_VALUES, smoothing: float = SMOOTHING, alike_z: float = ALIKE_Z, least_urls: int = LEAST_URLS) -> DataFrame:
    """host, segments, template, purity from host, segments, n, blocked, labelled (one row a shape).

    Step by step down the tree; every step is written, and those paths that end there leave it.
    """
    hosts = urls.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("blocked").alias("host_blocked"))
    n, blocked = hosts.agg(F.sum("host_n"), F.sum("host_blocked")).first()
    base = (blocked or 0) / n if n else 0.0
    hosts = hosts.select("host", ((F.col("host_blocked") + smoothing * base) / (F.col("host_n") + smoothing)).alias("share"))
    rows = urls.join(hosts, "host").select("host", "segments", "n", "blocked", "labelled", F.col("host").alias("node"), "share", F.lit(0).alias("k"))
    found, turn = [], 0
    more = F.size("segments") > F.col("k")
    ended = lambda df, where, template: df.where(where).select("host", "segments", template.alias("template"), F.col("share").alias("purity"))
    while True:
        rows = stored(_jumped(rows, smoothing, least_urls), f"url-steps-{turn}")
        found.append(ended(rows, ~more, F.col("node")))
        rows = rows.where(more)
        if rows.isEmpty():
            break
        rows, turn = stored(_level(rows, turn, max_values, smoothing, alike_z), f"url-level-{turn}"), turn + 1
        small = F.col("urls") < least_urls
        found.append(ended(rows, ~more | small, F.when(more, F.concat("node", F.lit("/{rest}"))).otherwise(F.col("node"))))
        rows = rows.where(more & ~small).drop("urls")
        if rows.isEmpty():
            break
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, max_values: int = MAX_VALUES, limit: float = PURITY) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template.

    A null url, or one without ://, has an empty host and path; it is a template of its own kind.
    Repeated rows and null ids give one row each. Other columns are not read. Equal shapes of urls
    are counted before anything is joined, so a host with many pages is a few rows of the tree.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    segments = F.transform(F.split(F.regexp_replace("path", "^/", ""), "/"), _typed)
    parsed = parsed.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), segments.alias("segments"))
    with scratch(pages.sparkSession):
        urls = parsed.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count_if(F.col("said") == "block").alias("blocked"), F.count("said").alias("labelled"))
        found = kept(stored(templates(stored(urls, "url-shapes"), max_values), "url-templates"))
    out = parsed.join(found, ["host", "segments"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("purity") >= limit, "block").otherwise("allow")).alias("verdict"), "template")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages."""
    return verdicts(table(spark, sf_dir, "pages"))


#: Levels that the SQL spells out; no path of the tables is deeper.
SQL_LEVELS = 9


def _sql() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda r: f"(host = '{r[0]}' or ends_with(host, '.{r[0]}')) and starts_with(path, '{r[1]}')"
    cases = lambda f: "case " + " ".join(f"when {fits(r)} then '{f(r)}'" for r in rules) + " end"
    ending = lambda x: rf"regexp_extract({x}, '\.[A-Za-z]{{1,5}}$')"
    typed = rf"case when regexp_matches(x, '^[0-9]+(\.[A-Za-z]{{1,5}})?$') then '{{n}}' || {ending('x')} when regexp_matches(x, '^[0-9a-f-]{{8,}}(\.[A-Za-z]{{1,5}})?$') and regexp_matches(x, '[0-9]') then '{{x}}' || {ending('x')} else x end"
    levels = []
    for k in range(1, SQL_LEVELS + 1):
        value, after = f"segments[{k}]", f"segments[{k + 1}]"
        kind = f"case when {after} is null then '$' when starts_with({after}, '{{') or {after} = '' then {after} else '{{w}}' || {ending(after)} end"
        sums = lambda p, q="": ", ".join(f"sum({p}{c}) as {q}{c}" for c in ("n", "blocked", "labelled"))
        levels.append(f"""
        wide{k} as materialized (select node from (select distinct node, {value} as v from open{k - 1}) group by node having count(*) > {MAX_VALUES}),
        val{k} as materialized (select o.*, case when w.node is not null and not starts_with({value}, '{{') then '{{w}}' || {ending(value)} else {value} end as v, {kind} as kind
            from open{k - 1} o left join wide{k} w using (node)),
        each{k} as materialized (select node, v, kind, regexp_replace(kind, '\\..*$', '') as type, {sums("")}, max(share) as share from val{k} group by all),
        types{k} as materialized (select node, v, type as most from (select node, v, type, sum(n) as c from each{k} where not starts_with(v, '{{') group by all)
            qualify row_number() over (partition by node, v order by c desc, type desc) = 1),
        kinds{k} as materialized (select e.*, most from each{k} e left join types{k} using (node, v)),
        pool{k} as materialized (select node, most, kind, {sums("", "pool_")} from kinds{k} where not starts_with(v, '{{') group by all),
        places{k} as (select node, most, count(*) as kinds, {sums("pool_", "all_")} from pool{k} group by node, most),
        branches{k} as (select node, v, most, {sums("")}, max(share) as share, sum(n * n / pool_n::double) as squares from kinds{k} left join pool{k} using (node, most, kind) group by node, v, most),
        tested{k} as materialized (select b.*, not starts_with(v, '{{') and squares * all_n / n - n <= (kinds - 1) + {ALIKE_Z} * sqrt(2.0 * (kinds - 1)) + 1e-9
            and case when labelled > 0 then coalesce(abs(blocked / labelled::double - all_blocked / nullif(all_labelled, 0)::double)
                <= {ALIKE_Z} * sqrt((all_blocked / nullif(all_labelled, 0)::double) * (1 - all_blocked / nullif(all_labelled, 0)::double) / labelled) + 1e-9, true) else true end as alike
            from branches{k} b left join places{k} using (node, most)),
        named{k} as materialized (select *, case when alike and count(*) filter (where alike) over (partition by node, most) > 1 then '{{m:' || most || '}}' else v end as branch from tested{k}),
        own{k} as (select node, branch, sum(n) as urls, (sum(blocked) + {SMOOTHING} * max(share)) / (sum(labelled) + {SMOOTHING}) as own_share from named{k} group by all),
        level{k} as materialized (select host, segments, a.n, a.blocked, a.labelled, a.node || '/' || branch as node, own_share as share, urls
            from val{k} a join named{k} using (node, v) join own{k} using (node, branch)),
        open{k} as materialized (select * exclude (urls) from level{k} where len(segments) > {k} and urls >= {LEAST_URLS})""")
    ends = " union all ".join(f"select host, segments, case when len(segments) > {k} then node || '/{{rest}}' else node end as template, share as purity from level{k} where len(segments) <= {k} or urls < {LEAST_URLS}" for k in range(1, SQL_LEVELS + 1))
    return rf"""
    with raw as (select page_id, coalesce(url, '') as u from pages),
    cut as (select page_id, case when contains(u, '://') then substr(u, instr(u, '://') + 3) else '' end as r from raw),
    split_ as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from cut),
    seg as (select *, {cases(lambda r: r[0] + r[1])} as rule, {cases(lambda r: r[2])} as said,
        string_split(case when starts_with(path, '/') then substr(path, 2) else path end, '/') as parts from split_),
    parsed as materialized (select page_id, host, path, rule, said, list_transform(parts, lambda x: {typed}) as segments from seg),
    shapes as materialized (select host, segments, count(*) as n, count(*) filter (where said = 'block') as blocked, count(said) as labelled from parsed group by all),
    hosts as (select host, (sum(blocked) + {SMOOTHING} * (select sum(blocked)::double / sum(n) from shapes)) / (sum(n) + {SMOOTHING})::double as share from shapes group by host),
    open0 as materialized (select host, segments, n, blocked, labelled, host as node, share from shapes join hosts using (host)),
    {",".join(levels)},
    judged as ({ends})
    select page_id, parsed.host, path, rule, coalesce(said, case when purity >= {PURITY} then 'block' else 'allow' end) as verdict, template
    from parsed join judged on parsed.host = judged.host and parsed.segments = judged.segments
    """


SQL = _sql()
