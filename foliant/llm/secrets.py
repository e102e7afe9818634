"""Secret scan with multipart credential linking (DataFrame operations only).

Three strong kinds are reported wherever they match. Weak kinds (identifiers,
keys without a prefix, endpoints) are candidates only: an interval join within
the document links parts whose starts lie within a scope, and a candidate is
reported only where the parts that complete a credential co-occur:

* an identifier needs a secret (strong or weak) within the scope,
* a bare key needs an identifier,
* an endpoint needs both an identifier and a secret.

The join is a sweep over the spans in order of their starts (a range frame),
so its cost is linear in the spans: no pairs are made. Texts stay where they
are read; only spans of documents with candidates are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.folds import fold_each
from foliant.llm.text import whole
from foliant.runtime import materialize

SCOPE = 256
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: (pattern, role). A maximal run of a class of at least n characters is what the run's filter by length leaves.
STRONG = {"assign": (ASSIGN, "secret"), "access": (r"AKIA[A-Z0-9]{16,}", "id"), "hex": (r"[0-9a-f]{24,}", "secret")}
WEAK = {
    "ident": (r"""(?i)(?:access_?key_?id|client_?id|user_?name|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}|(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}""", "id"),
    "key": (r"(?<![A-Za-z0-9/+=])(?=[A-Za-z0-9/+]{0,39}[0-9])(?=[A-Za-z0-9/+]{0,39}[A-Z])(?=[A-Za-z0-9/+]{0,39}[a-z])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])", "secret"),
    "endpoint": (r"""[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20"'<>]{4,}""", "endpoint"),
}
KINDS = [*STRONG, *WEAK]
_SPAN = "struct<start:bigint,ord:int,end:bigint>"
_SPANS = f"array<{_SPAN}>"


def find_spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Leftmost non-overlapping matches as (start, ord, end) in code points; ``keep`` tests a match after the fact."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.transform(gaps, lambda g: F.length(g)).alias("g"), hits.alias("h"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["g"]
        end = start + F.coalesce(F.length(x["h"]), F.lit(0))
        ok = x["h"].isNotNull() if keep is None else x["h"].isNotNull() & keep(x["h"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(ok, span).alias("span"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(None).cast(_SPAN).alias("span"))
    return F.filter(fold_each(parts, zero, step, lambda state: state["span"], _SPAN), lambda span: span.isNotNull())


def _none() -> Column:
    return F.array().cast(_SPANS)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """uid, doc_id, strong, weak (arrays of spans) for each row; written once.

    The tests before the expressions are necessary conditions that are cheap
    to check; weak kinds are searched only where an identifier may be.
    """
    t = F.col("t")
    words = F.lower(t)
    mentions = words.contains("pass") | words.contains("secret") | words.contains("token") | words.contains("api")
    six = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), whole(text).alias("t"))
    rows = rows.withColumn("assign", F.when(mentions, find_spans(t, ASSIGN, "assign", six)).otherwise(_none()))
    rows = rows.withColumn("access", F.when(t.contains("AKIA"), find_spans(t, STRONG["access"][0], "access")).otherwise(_none()))
    rows = rows.withColumn("hex", F.when(t.rlike(STRONG["hex"][0]), find_spans(t, STRONG["hex"][0], "hex")).otherwise(_none()))
    rows = rows.withColumn("ident", F.when(t.rlike(WEAK["ident"][0]), find_spans(t, WEAK["ident"][0], "ident")).otherwise(_none()))
    has_id = (F.size("access") > 0) | (F.size("ident") > 0)
    rows = rows.withColumn("key", F.when(has_id, find_spans(t, WEAK["key"][0], "key")).otherwise(_none()))
    rows = rows.withColumn("endpoint", F.when(has_id & t.contains("://"), find_spans(t, WEAK["endpoint"][0], "endpoint")).otherwise(_none()))
    return materialize(rows.select("uid", "doc_id", F.array_sort(F.concat(*STRONG)).alias("strong"), F.array_sort(F.concat(*WEAK)).alias("weak")), "spans")


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """uid and the array ``extra`` of the weak spans that are linked and overlap no strong span."""
    spans = (
        scanned.where(F.size("weak") > 0)
        .select("uid", F.explode(F.concat("strong", "weak")).alias("s"))
        .select("uid", "s.start", "s.ord", "s.end")
    )
    roles = [role for _, role in (STRONG | WEAK).values()]
    role = F.element_at(F.array(*[F.lit(r) for r in roles]), F.col("ord") + 1)
    spans = spans.withColumn("role", role)
    near = Window.partitionBy("uid").orderBy("start").rangeBetween(-scope, scope)
    beside = {r: F.count(F.when(F.col("role") == r, 1)).over(near) > 0 for r in ("id", "secret")}
    strong = F.col("ord") < len(STRONG)
    by_start = Window.partitionBy("uid").orderBy("start", "ord")
    ended = F.max(F.when(strong, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    # backwards, as Spark goes over a frame to the end of the rows again for each row
    from_end = Window.partitionBy("uid").orderBy(F.desc("start"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    begins = F.last(F.when(strong, F.col("start")), ignorenulls=True).over(from_end)
    free = (F.coalesce(ended, F.lit(-1)) <= F.col("start")) & F.coalesce(begins >= F.col("end"), F.lit(True))
    told = spans.select("uid", "start", "ord", "end", "role", free.alias("free"), *[v.alias(f"with_{k}") for k, v in beside.items()])
    complete = F.when(F.col("role") == "id", F.col("with_secret")).when(F.col("role") == "secret", F.col("with_id")).otherwise(F.col("with_id") & F.col("with_secret"))
    weak = told.where((F.col("ord") >= len(STRONG)) & F.col("free") & complete)
    return weak.groupBy("uid").agg(F.collect_list(F.struct("start", "ord", "end")).alias("extra"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans (an empty string); repeated rows each
    give their row; an empty table gives an empty result. Spans are
    ``kind:start:end`` in code points, end exclusive, sorted by start, then kind.
    """
    scanned = scan(docs, doc_id, text)
    count = lambda kind: F.size(F.filter("strong", lambda s: s["ord"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("strong", F.coalesce("extra", _none())))
    return scanned.join(linked(scanned), "uid", "left").select(
        "doc_id", *map(count, STRONG), F.sha2(_listed(F.col("strong")), 256).alias("base_sha256"), _listed(every).alias("spans")
    )
