"""URL filters: a tree of path templates for each host, in DataFrame operations only.

From branching to branching, a path segment becomes a wildcard if it is one of many rare children of its node, or if
there are labels enough to say that its pages are like those of its siblings; digits are wildcards from the start. The
paths that become equal are one template. A template is rejected if the share of good pages among its labelled ones,
smoothed towards its host's and that towards the whole table's, is too low.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import discard, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (and what it says) whose host is the host or a parent domain and whose path starts the path."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> Column:
    """Parts of the path with digits (and long hexadecimal names) made wildcards; a part that is an asterisk is spelled ``%2A``."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike(r"^[0-9a-fA-F-]{12,}$"), "#").when(x == "*", "%2A").otherwise(F.regexp_replace(x, "[0-9]+", "#")))


def _alike(labelled: Column, good: Column, others: Column, others_good: Column, enough: int, z: float) -> Column:
    """Whether two shares of good pages, each of ``enough`` labelled ones or more, can't be told apart."""
    p = (good + others_good) / (labelled + others)
    error = F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) * (1 / labelled + 1 / others))
    return F.when((labelled >= enough) & (others >= enough), F.abs(good / labelled - others_good / others) <= z * error + 1e-12).otherwise(False)


def _wildcards(inner: DataFrame, many: int, rare: float, enough: int, z: float) -> DataFrame:
    """``host, node, segment, as``: the name of each child. inner: ``host, node, segment, n, labelled, good``."""
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "good")]
    at = ["host", "node"]
    # tables of their own, so that Spark can split a node of very many children when they are joined
    children = written(inner.groupBy(*at, "segment").agg(*sums), "children")
    nodes = written(children.groupBy(*at).agg(F.count("*").alias("kids"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "good")]), "nodes")
    by_count = (F.col("kids") >= many) & (F.col("n") < rare * F.col("all_n"))
    like_others = _alike(F.col("labelled"), F.col("good"), F.col("all_labelled") - F.col("labelled"), F.col("all_good") - F.col("good"), enough, z)
    judged = written(children.join(nodes, at).select(*at, "segment", "labelled", "good", by_count.alias("rare"), (~by_count & like_others).alias("like")), "children")
    pools = written(judged.where("rare or like").groupBy(*at).agg(F.sum("labelled").alias("pool"), F.sum("good").alias("pool_good")), "pools")
    # those like all others are tested again, against what would be merged with them
    stays = F.col("like") & _alike(F.col("labelled"), F.col("good"), F.col("pool") - F.col("labelled"), F.col("pool_good") - F.col("good"), enough, z)
    named = written(judged.join(pools, at, "left").select(*at, "segment", F.when(F.col("rare") | stays, "*").otherwise(F.col("segment")).alias("as")), "names")
    discard(children, nodes, judged, pools)
    return named


def path_templates(pages: DataFrame, labels: DataFrame, many: int = 8, rare: float = 0.05, enough: int = 5, alike: float = 1.96, smoothing: float = 10.0, id_col: str = "page_id", url_col: str = "url", label_col: str = "good") -> tuple[DataFrame, DataFrame]:
    """Pages with their templates (``page_id, host, path, template``) and the templates (``host, template, n_pages,
    n_labelled, n_good, purity``).

    ``labels`` has ``label_col`` 0 or 1 for some ids; several of one id are averaged, nulls don't count. Of the
    children of a node, those of less than ``rare`` of its pages merge where there are ``many`` children, whatever
    their labels; others merge if they are like the rest of the node, and again like what merges with them, by a test
    of two proportions (``alike`` standard errors) with ``enough`` labelled pages on either side. Paths are walked to
    their ends, in as many rounds as paths branch one after another.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("page_id")).agg(F.avg(label_col).alias("_good"))
    url = F.col(url_col)
    read = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    read = written(read.join(known, "page_id", "left").select("page_id", "host", "path", "_good"), "pages").withColumn("segments", _segments(F.col("path")))
    counts = F.count("*").alias("n"), F.count("_good").alias("labelled"), F.coalesce(F.sum("_good"), F.lit(0.0)).alias("good")
    live = written(read.groupBy("host", "segments").agg(*counts).select("*", F.lit("").alias("node"), F.col("segments").alias("rest")), "paths")
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "good")]
    kept, ends = ["host", "segments", "n", "labelled", "good"], []
    while not live.isEmpty():
        # what all paths of a node begin with is what the first and the last in order do
        groups = written(live.groupBy("host", "node").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi")), "groups")
        apart = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
        common = F.when(apart == 0, F.size("lo")).otherwise(apart - 1)
        begun = live.join(groups.select("host", "node", common.alias("common")), ["host", "node"])
        at = written(begun.select(*kept, F.concat_ws("/", "node", F.slice("rest", F.lit(1), F.col("common"))).alias("node"), F.slice("rest", F.col("common") + 1, F.size("rest")).alias("rest")), "paths")
        discard(live, groups)
        ends.append(at.where(F.size("rest") == 0).select(*kept, "node"))
        inner = at.where(F.size("rest") > 0).withColumn("segment", F.get("rest", F.lit(0)))
        named = _wildcards(inner, many, rare, enough, alike)
        live = written(inner.join(named, ["host", "node", "segment"]).select(*kept, F.concat_ws("/", "node", "as").alias("node"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest")), "paths")
        discard(named)
    paths = ends[0] if ends else live.select(*kept, "node")
    for more in ends[1:]:
        paths = paths.unionByName(more)
    templates = paths.groupBy("host", F.col("node").alias("template")).agg(*sums)
    hosts = templates.groupBy("host").agg(F.sum("labelled").alias("_labelled"), F.sum("good").alias("_good"))
    total = hosts.agg(F.sum("_good"), F.sum("_labelled")).first()
    overall = (total[0] or 0.0) / total[1] if total[1] else 1.0
    host_share = (F.col("_good") + smoothing * overall) / (F.col("_labelled") + smoothing)
    purity = (F.col("good") + smoothing * host_share) / (F.col("labelled") + smoothing)
    scored = templates.join(hosts, "host").select("host", "template", F.col("n").alias("n_pages"), F.col("labelled").alias("n_labelled"), F.col("good").alias("n_good"), purity.alias("purity"))
    placed = read.join(paths.select("host", "segments", F.col("node").alias("template")), ["host", "segments"]).select("page_id", "host", "path", "template")
    return placed, written(scored, "templates")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = (), min_purity: float = 0.7, id_col: str = "page_id", url_col: str = "url", label_col: str = "good", **options) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row.

    ``rules`` are pairs of ``allow`` or ``block`` and a host with a path (``example.com/en/``); the longest that fits
    decides. Elsewhere a page is blocked if its template's purity is under ``min_purity``.

    Very long urls are walked to their ends. Of rules of one length that fit, the later in order counts. A null url, and one without ``://``, has an empty host and path and is judged with others of the kind. Pages with
    null ids have no label. Repeated rows are each judged and each count. Without labels every template is allowed.
    An empty table gives an empty result. Other columns aren't read.
    """
    placed, templates = path_templates(pages, labels, id_col=id_col, url_col=url_col, label_col=label_col, **options)
    rule, says = rule_for(F.col("host"), F.col("path"), list(rules))
    own = F.when(F.col("purity") < min_purity, "block").otherwise("allow")
    beside = placed.join(templates.select("host", "template", "purity"), ["host", "template"], "left")
    return beside.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"), "template", "purity")
