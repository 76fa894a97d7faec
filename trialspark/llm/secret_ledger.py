"""Secret scanning with an incremental ledger of blobs, in DataFrame expressions only.

Every version of a text is a blob, addressed by the SHA-256 of its bytes. The ledger
holds the (blob, rule version) pairs that were scanned; a run scans only pairs that it
lacks, reads one path's text for each blob, and joins the findings back to all paths.

Positions come without user code: ``split`` gives the gaps between a rule's matches and
``regexp_extract_all`` the matches, so running sums of their lengths are the starts.
Lengths are in code points. Only texts in which a rule matches reach that step.

The shuffle that fetches one text per blob is keyed by (path, blob), so a blob with
very many paths is not gathered in one task.

Defined cases: a null text counts as empty; copies share their findings; repeated rows
get the same result each; a null path is a path of its own; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted, save


@dataclass(frozen=True)
class Rule:
    """A pattern; the group named must have ``least`` characters, shorter matches are dropped."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    base: bool = False
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}.{self.version}"


#: a private key from its header to its END line, with nothing dashed between; one cut off before END to its last base64
#: line: headers, runs of 16 or more on any line, and one shorter run that is a line. Line breaks may be written as \\n.
#: The repeats are possessive, so a long text neither overflows the stack nor is searched twice.
PEM = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?:(?:[\s>]|\\[nrt])++[A-Z][A-Za-z]*+-[A-Z][A-Za-z]*+:(?:(?!\\[nr])[^\n])*+)*+"
    r"(?:(?:[\s>]|\\[nrt])++[A-Za-z0-9+/]{16,}+={0,2}+)*+"
    r"(?:[ \t]*+(?:\r?\n|\\r|\\n)(?:[\s>]|\\[nrt])*+[A-Za-z0-9+/]++={0,2}+(?=[ \t]*+(?:[\r\n\\\"']|$)))?+)"
)
#: in the order of the digest; ``base`` rules first
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]{24,}", 24, 0, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 28),
    Rule("pem", PEM, 27, version=2),
)
EMPTY_LEDGER = "blob_id string, rule string"
FINDINGS = "blob_id string, rule string, kind string, start long, end long"


def blob_id(text_col: str):
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


def versions(docs: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(_path, blob_id) of every row."""
    return docs.select(F.col(path_col).alias("_path"), blob_id(text_col).alias("blob_id"))


def unseen(stored: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob_id, _path, rules): one path for each blob with rules that the ledger lacks."""
    blobs = stored.groupBy("blob_id").agg(F.min("_path").alias("_path"))
    done = ledger.groupBy("blob_id").agg(F.collect_set("rule").alias("_done"))
    every = F.array(*[F.lit(r.key) for r in rules])
    return (
        blobs.join(done, "blob_id", "left")
        .withColumn("rules", F.array_except(every, F.coalesce("_done", F.array().cast("array<string>"))))
        .where(F.size("rules") > 0)
        .drop("_done")
    )


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of (blob_id, text, rules): every match of every listed rule with its place."""
    # the output of a generator is a new column: conditions on it stay above the join that picks
    # the unseen blobs, so no other text is searched
    fresh = blobs.select("blob_id", "rules", F.explode(F.array("text")).alias("text"))

    def lengths(pieces):
        return F.transform(pieces, F.length)

    tried = []
    for rule in rules:
        parts = F.struct(
            F.lit(rule.key).alias("rule"),
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.least).alias("least"),
            lengths(F.split("text", rule.pattern, -1)).alias("gaps"),
            lengths(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))).alias("whole"),
            lengths(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))).alias("part"),
        )
        tried.append(F.when(F.array_contains("rules", rule.key) & F.col("text").rlike(rule.pattern), parts))
    found = fresh.select("blob_id", F.inline(F.filter(F.array(*tried), lambda x: x.isNotNull())))
    each = found.select("blob_id", "rule", "kind", "least", F.posexplode(F.arrays_zip("gaps", "whole", "part")).alias("i", "m"))
    upto = Window.partitionBy("blob_id", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    # the row after the last match has a gap and no match
    placed = each.select("*", "m.*").withColumn("end", F.sum(F.col("gaps") + F.coalesce("whole", F.lit(0))).over(upto).cast("long"))
    return placed.where("part >= least").select("blob_id", "rule", "kind", (F.col("end") - F.col("whole")).cast("long").alias("start"), "end")


def update(
    docs: DataFrame,
    ledger: DataFrame | None = None,
    findings: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    path_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run: (versions of the paths, ledger after it, findings after it), all stored.

    ``ledger`` and ``findings`` are what an earlier run returned.
    """
    spark = docs.sparkSession
    ledger = ledger if ledger is not None else spark.createDataFrame([], EMPTY_LEDGER)
    findings = findings if findings is not None else spark.createDataFrame([], FINDINGS)
    stored = save(versions(docs, path_col, text_col), "versions")
    todo = save(unseen(stored, ledger, rules), "unseen").withColumnRenamed("blob_id", "_blob").withColumnRenamed("_path", "_of")
    texts = docs.select(F.col(path_col).alias("_path"), blob_id(text_col).alias("blob_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = texts.join(todo.hint("shuffle_hash"), F.col("_path").eqNullSafe(F.col("_of")) & (F.col("blob_id") == F.col("_blob")))
    # repeated rows, and rows without a path that share a text, all meet their pair: scan() takes one text for each blob
    held = held.dropDuplicates(["_path", "blob_id"])
    new = scan(held.select("blob_id", "text", "rules"), rules)
    all_found = save(findings.union(new), "findings")
    pairs = todo.select(F.col("_blob").alias("blob_id"), F.explode("rules").alias("rule"))
    return stored, save(ledger.union(pairs), "ledger"), all_found


def current(findings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of the given rule versions, with the rule's rank."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    return findings.where(F.col("rule").isin([r.key for r in rules])).withColumn("rank", rank[F.col("rule")])


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base rules, and digests of the spans."""
    stored, _, findings = update(docs, rules=rules, path_col=path_col, text_col=text_col)
    per_blob = (
        current(findings, rules)
        .groupBy("blob_id")
        .agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("found"))
        .withColumnRenamed("blob_id", "_blob")
    )
    base = "array(" + ",".join(f"'{r.kind}'" for r in rules if r.base) + ")"
    listed = "array_join(transform({}, f -> concat(f.kind, ':', f.start, ':', f.end)), ',')"
    only = f"filter(found, f -> array_contains({base}, f.kind))"
    counts = [F.expr(f"coalesce(size(filter(found, f -> f.kind = '{r.kind}')), 0)").cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return (
        stored.join(per_blob, F.col("blob_id") == F.col("_blob"), "left")
        .withColumn("found", F.coalesce("found", F.expr("filter(array(named_struct('start', 0L, 'rank', 0, 'kind', '', 'end', 0L)), f -> false)")))
        .select(
            F.col("_path").alias(path_col),
            *counts,
            F.sha2(F.expr(listed.format(only)).cast("binary"), 256).alias("base_sha256"),
            F.expr(listed.format("found")).alias("spans"),
            "blob_id",
        )
    )


def redacted(docs: DataFrame, mask: str = "<secret>", rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents with every found span replaced by ``mask``; columns and all other texts stay."""
    _, _, findings = update(docs, rules=rules, path_col=path_col, text_col=text_col)
    merge = """aggregate(sort_array(collect_list(struct(start, end))), cast(array() as array<struct<start:bigint,end:bigint>>),
        (out, s) -> if(size(out) > 0 and s.start < element_at(out, -1).end,
            concat(slice(out, 1, size(out) - 1), array(named_struct('start', element_at(out, -1).start, 'end', greatest(element_at(out, -1).end, s.end)))),
            concat(out, array(s))))"""
    blob, mine, new, cut = fresh(docs, "_blob", "_blob_id", "_new", "_cuts")
    cuts = current(findings, rules).groupBy(F.col("blob_id").alias(blob)).agg(F.expr(merge).alias(cut))
    text = quoted(text_col)
    # the pieces before each cut, then what follows the last
    rebuilt = f"""concat(array_join(transform({cut}, (s, i) -> substring({text},
        cast(if(i = 0, 0, {cut}[i - 1].end) + 1 as int), cast(s.start - if(i = 0, 0, {cut}[i - 1].end) as int))), '{mask}'),
        '{mask}', substring({text}, cast(element_at({cut}, -1).end + 1 as int)))"""
    out = docs.withColumn(mine, blob_id(text_col)).join(cuts, F.col(mine) == F.col(blob), "left")
    out = out.withColumn(new, F.when(F.col(cut).isNotNull(), F.expr(rebuilt)).otherwise(F.col(text)))
    columns = []
    for f in docs.schema:
        if f.name == text_col:
            columns.append(F.col(new).alias(f.name))
        elif f.name == chars_col:
            columns.append(F.when(F.col(cut).isNotNull(), F.length(new)).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name))
        else:
            columns.append(F.col(quoted(f.name)))
    return out.select(*columns)
