r"""Secret scans with corpus-wide ownership frequency, in SQL functions only.

A first pass finds candidate spans in every text: assignments, access keys and hexadecimal runs (the base kinds) and
further shapes of credentials. Positions come from the pieces between the matches: ``split`` and ``regexp_extract_all`` with one
pattern give gaps and matches in turn, whose lengths add up (running sums over the pieces of a row, so the work for a text is linear in
its matches, but for sorting). Then candidates are counted by the hash of their value: how many distinct owners and repositories have
it. A value that ``example_owners`` or more owners or ``example_repos`` or more repositories have is a widely copied example; any
other looks live. Base spans are always reported; a further span is added only if its value looks live.

Scale: one pass of the texts, of which only lengths and hashes are kept (staged in the shared folder, for both the
counting and the verdicts). Counting is three nested aggregations, each combined before its shuffle, so a value in a third
of all rows is one row for each task. The counts are staged before they are joined back by hash, so that no aggregation lies between
shuffle and join and AQE splits a hot value; likewise the spans that ``redact`` joins to texts. Rows without candidates take no part in
any shuffle.

Cases: a null text is empty; a null owner counts as one owner; rows with repeated or null ids are kept one for one; very long
texts are read whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import col, fresh, staged

KEYWORDS = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
#: kind, pattern, group that holds the value, least length of the value. The first three are the base kinds.
KINDS = (
    ("assign", KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 0, 1),
    ("vendor", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|glpat-[A-Za-z0-9_-]{20,})", 0, 1),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
    ("entropy", r"(?<![A-Za-z0-9+/_-])(?=[a-z+/_-]*+[A-Z0-9])(?=[A-Z0-9+/_-]*+[a-z])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{32,}+", 0, 32),
)
BASE = 3
PIECE = "struct<rank:int,gap:int,size:int,hash:string>"
#: A cheap test that no candidate of any kind fails.
ANY = KEYWORDS + r"""["']?\x20*[:=]|AKIA|[0-9a-f]{24}|eyJ[A-Za-z0-9_-]{10}|gh[pousr]_|xox[abprs]-|AIza|glpat-|-----BEGIN |[A-Za-z0-9+/_-]{32}"""


def _pieces(text: Column, rank: int) -> Column:
    """The matches of a kind and the gaps before them, by length; a match that fails has no hash."""
    _, pattern, group, least = KINDS[rank]
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"), F.split(text, pattern, -1).alias("gap"))
    size = lambda x: F.coalesce(F.length(x), F.lit(0))
    piece = lambda p: F.struct(F.lit(rank).alias("rank"), size(p["gap"]).alias("gap"), size(p["match"]).alias("size"), F.when(F.length(p["value"]) >= least, F.sha2(p["value"], 256)).alias("hash"))
    return F.when(text.rlike(pattern), F.transform(parts, piece)).otherwise(F.array().cast(f"array<{PIECE}>"))


def pieces(text: Column) -> Column:
    """The pieces of all kinds, kind by kind; empty where no match of any kind passes."""
    every = F.concat(*(_pieces(text, k) for k in range(len(KINDS))))
    return F.when(text.rlike(ANY), every).otherwise(F.array().cast(f"array<{PIECE}>"))


def placed(rows: DataFrame) -> DataFrame:
    """Rows (row_key, pieces) as (row_key, start, rank, end, hash) of the matches that pass."""
    each = rows.select("row_key", F.posexplode("pieces").alias("at", "p")).select("row_key", "at", "p.*")
    so_far = Window.partitionBy("row_key", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int"))
    return ends.where(F.col("hash").isNotNull()).select("row_key", (F.col("end") - F.col("size")).alias("start"), "rank", "end", "hash")


def ownership(spans: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos of rows (hash, owner, repo), as exact counts of distinct values."""
    once = spans.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), example_owners: int = 3, example_repos: int = 6
) -> DataFrame:
    """doc_id, row_hash, spans (array of start, rank, end, kind, hash, live) of every row.

    Owner and repository are columns of the table; here a repository is a source in one language. ``row_hash`` is
    the SHA-256 of id and text, for joining the spans to their texts.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    known = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    row_hash = F.when(text.rlike(ANY), row_hash_of(col(id_col), text))
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), row_hash.alias("row_hash"), known(owner_col).alias("owner"), F.concat_ws("\x1f", *(known(c) for c in repo_cols)).alias("repo"), pieces(text).alias("pieces"))
    narrow = staged(rows.withColumn("row_key", F.monotonically_increasing_id()), "spans")
    some = F.exists("pieces", lambda p: p["hash"].isNotNull())
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,hash:string,live:boolean>>")
    plain = narrow.where(~some).select("doc_id", "row_hash", none.alias("spans"))
    hashes = narrow.where(some).select("owner", "repo", F.explode("pieces.hash").alias("hash")).where(F.col("hash").isNotNull())
    live = (F.col("n_owners") < example_owners) & (F.col("n_repos") < example_repos)
    counts = staged(ownership(hashes).select("hash", live.alias("live")), "owners")
    judged = placed(narrow.where(some)).join(counts, "hash")
    kind = F.element_at(F.array(*(F.lit(k[0]) for k in KINDS)), F.col("rank") + 1).alias("kind")
    kept = judged.where((F.col("rank") < BASE) | F.col("live")).groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", kind, "hash", "live"))).alias("spans"))
    found = narrow.where(some).select("row_key", "doc_id", "row_hash").join(kept, "row_key", "left")
    return plain.unionByName(found.select("doc_id", "row_hash", F.coalesce("spans", none).alias("spans")))


def row_hash_of(doc_id: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("\n"), text), 256)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", piece: int = 4096, **options) -> DataFrame:
    """The same rows and columns, with the spans of every text replaced; overlapping spans become one mask.

    Texts without a candidate are passed on as they are; the others meet their spans by the hash of the row and are masked in pieces of
    ``piece`` code points, each with the spans that reach into it.
    """
    key, spans = fresh(docs.columns, "__row_hash", "__spans")
    found = scan(docs, id_col, text_col, **options).where(F.size("spans") > 0).select(F.col("row_hash").alias(key), F.transform("spans", lambda s: F.struct(s["start"], s["end"])).alias(spans)).dropDuplicates([key])
    found = staged(found, "masks")
    text = F.coalesce(col(text_col), F.lit(""))
    plain, some = docs.where(~text.rlike(ANY)), docs.where(text.rlike(ANY))
    met = some.withColumn(key, row_hash_of(col(id_col), text)).join(found, key, "left")

    def masked(part: Column, number: Column) -> Column:
        begin = number * piece

        def step(state: Column, s: Column) -> Column:
            gap = F.substring(part, state["at"] - begin + 1, F.greatest(s["start"], state["at"]) - state["at"])
            new = F.when(s["start"] >= state["at"], F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"])
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), new.alias("out"))

        here = F.filter(spans, lambda s: (s["end"] > begin) & (s["start"] < begin + piece))
        return F.aggregate(here, F.struct(begin.alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(part, s["at"] - begin + 1, F.lit(piece))))

    parts = F.regexp_extract_all(col(text_col), F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    done = met.withColumn(text_col, F.when(F.size(spans) > 0, F.array_join(F.transform(parts, masked), "")).otherwise(col(text_col)))
    return plain.unionByName(done.select(*(col(c) for c in docs.columns)))
