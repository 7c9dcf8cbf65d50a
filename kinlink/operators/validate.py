"""Rules for the output files, as one table of issues."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import by_shuffle, cut_lineage

#: Examples kept for each issue.
EXAMPLES = 5
MATCHING = ("source1_entity_id", "matched_entity_ids")
CANDIDATES = ("source1_entity_id", "candidate_entity_ids")


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    rows: int = 0
    empty: int = 0

    @property
    def ok(self) -> bool:
        return not self.errors

    @property
    def exit_code(self) -> int:
        return 0 if self.ok else 1


def header_problem(line: str | None, expected: tuple[str, str]) -> str | None:
    """What is wrong with the first line of a file, or None."""
    if line is None:
        return "the file is empty"
    if "\t" not in line:
        return "the header looks COMMA-separated" if "," in line else "the header has no TAB"
    found = [c.strip().lower() for c in line.split("\t")]
    return None if found == list(expected) else f"the header is {found}, expected {list(expected)}"


def parsed(lines: DataFrame) -> DataFrame:
    """(source1_entity_id, ids) of lines (a column value) that have a TAB; a list's items are not trimmed."""
    good = lines.where(F.instr("value", "\t") > 0)
    rest = F.expr("substr(value, instr(value, '\t') + 1)")
    return good.select(
        F.substring_index("value", "\t", 1).alias("source1_entity_id"),
        F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, ",")).alias("ids"),
    )


def issues(rows: DataFrame, required: DataFrame | None = None, known: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """(issue, n, examples) of id lists. required has the reference ids (entity_id), known those of the candidates; lines are
    the raw lines, for rows without a TAB.

    One pass: a row gives what is wrong with itself, its id and the ids of its list, which are counted by kind and key before
    the shuffle and meet the required and known ids there."""

    def event(kind: str, key: Column, when: Column | None = None) -> Column:
        made = F.struct(F.lit(kind).alias("kind"), key.alias("key"))
        return made if when is None else F.when(when, made)

    ids, source = F.col("ids"), F.col("source1_entity_id")
    own = F.array(event("row", source), event("duplicate id in a list", source, F.size(ids) != F.size(F.array_distinct(ids))))
    each = F.transform(ids, lambda x: F.array(event("self match", x, x.startswith("S1-")), event("bad prefix", x, ~x.rlike("^S[123]-")), event("id", x, x.rlike("^S[23]-"))))
    found = rows.select(F.explode(F.array_compact(F.concat(own, F.flatten(each)))).alias("e")).select("e.kind", "e.key")
    if lines is not None:
        bad = lines.where((F.instr("value", "\t") == 0) & (F.regexp_replace("value", r"\s", "") != ""))
        found = found.union(bad.select(F.lit("no TAB"), "value"))
    counted = found.groupBy("kind", "key").agg(F.count("*").alias("n"))
    for kind, wanted in (("row", required), ("id", known)):
        there = F.lit(None).cast("boolean") if wanted is None else F.lit(True)
        of = counted.limit(0).select("kind", "key") if wanted is None else wanted.select(F.lit(kind).alias("kind"), F.col("entity_id").alias("key")).distinct()
        every = of.withColumn("there", there) if kind == "row" else every.union(of.withColumn("there", there))
    met = counted.join(every, ["kind", "key"], "full_outer")
    absent, row = F.col("there").isNull(), F.col("kind") == "row"
    told = F.array(
        F.when(row & (F.col("n") > 1), F.struct(F.lit("duplicate row").alias("issue"), F.lit(1).cast("long").alias("n"))),
        F.when(row & F.col("n").isNull(), F.struct(F.lit("missing id").alias("issue"), F.lit(1).cast("long").alias("n"))),
        *([] if required is None else [F.when(row & absent, F.struct(F.lit("unknown id").alias("issue"), F.col("n")))]),
        *([] if known is None else [F.when((F.col("kind") == "id") & absent, F.struct(F.lit("id not in the sources").alias("issue"), F.col("n")))]),
        F.when(~F.col("kind").isin("row", "id"), F.struct(F.col("kind").alias("issue"), F.col("n"))),
    )
    wrong = cut_lineage(met.select(F.explode(F.array_compact(told)).alias("e"), "key").select("e.issue", "e.n", F.col("key").alias("example")))
    # Examples are the first of the distinct ones, cut before they are gathered.
    first = wrong.withColumn("k", F.row_number().over(Window.partitionBy("issue").orderBy("example"))).where(F.col("k") <= EXAMPLES)
    lists = first.groupBy("issue").agg(F.array_join(F.sort_array(F.collect_list("example")), ",").alias("examples"))
    return wrong.groupBy("issue").agg(F.sum("n").alias("n")).join(lists, "issue")


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows whose matches are not all among their candidates; both (source1_entity_id, ids)."""
    both = matches.join(candidates.withColumnRenamed("ids", "allowed"), "source1_entity_id", "left")
    extra = F.array_except("ids", F.coalesce("allowed", F.array().cast("array<string>")))
    return both.select("source1_entity_id", extra.alias("extra")).where(F.size("extra") > 0)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def validate_files(spark: SparkSession, matching: str, candidates: str | None = None, required: DataFrame | None = None, known: DataFrame | None = None, strict_subset: bool = False) -> Report:
    """Checks a file of matches and, if there is one, of candidates. Ids outside the candidates are a warning, or an error if
    strict_subset."""
    report = Report()
    parts = {}
    for path, expected in ((matching, MATCHING), (candidates, CANDIDATES)):
        if path is None:
            report.warnings.append("no candidate file")
            continue
        try:
            lines = _lines(spark, path)
            first = lines.first()
        except Exception as e:  # a missing or unreadable file is a finding
            (report.errors if expected == MATCHING else report.warnings).append(f"{path}: cannot be read ({type(e).__name__})")
            continue
        if problem := header_problem(first[0] if first else None, expected):
            report.errors.append(f"{path}: {problem}")
            continue
        heads = lines.where(F.lower("value") == first[0].lower()).groupBy(F.input_file_name()).agg((F.count("*") - 1).alias("n"))
        if again := heads.agg(F.sum("n")).first()[0]:
            report.errors.append(f"{path}: repeated header ({again})")
        body = lines.where(F.lower("value") != first[0].lower())
        parts[expected] = parsed(body)
        for r in issues(parts[expected], required, known, body).orderBy("issue").collect():  # a row for each kind of issue
            report.errors.append(f"{path}: {r['issue']} ({r['n']}): {r['examples']}")
        if expected == MATCHING:
            r = parts[expected].agg(F.count("*").alias("n"), F.count_if(F.size("ids") == 0).alias("e")).first()
            report.rows, report.empty = r["n"], r["e"]
    if len(parts) == 2 and (n := outside_candidates(parts[MATCHING], parts[CANDIDATES]).count()):
        (report.errors if strict_subset else report.warnings).append(f"{n} rows have matches outside their candidates")
    return report


def validate_lists(matching: DataFrame, candidates: DataFrame, required: DataFrame, known: DataFrame) -> list[str]:
    """The stricter check of tables as read, in the order of the reference ids: numbers of rows and columns first; then what is
    wrong with the first id that has anything wrong, of a repeated match, a repeated candidate, a match outside the candidates,
    a candidate's prefix and a candidate that the sources don't have. An empty result means that all is right."""
    errors, sides = [], []
    n = required.count()
    for rows, columns in ((matching, MATCHING), (candidates, CANDIDATES)):
        if rows.count() != n:
            errors.append(f"{columns[1]}: {rows.count()} rows, expected {n}")
        if tuple(rows.columns) != columns:
            errors.append(f"columns are {rows.columns}, expected {list(columns)}")
            return errors
        found = F.filter(F.transform(F.split(F.coalesce(columns[1], F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
        sides.append(rows.groupBy("source1_entity_id").agg(F.last(found).alias(columns[1])))
    need = required if "row" in required.columns else required.withColumn("row", F.monotonically_increasing_id())
    need = need.select(F.col("entity_id").alias("source1_entity_id"), "row")
    both = need.join(sides[0], "source1_entity_id", "left").join(sides[1], "source1_entity_id", "left")
    both = both.select("row", "source1_entity_id", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("matched_entity_ids", "candidate_entity_ids")))
    m, c = F.col("matched_entity_ids"), F.col("candidate_entity_ids")

    def fault(number: int, example: Column) -> Column:
        return F.struct(F.lit(number).alias("rule"), example.alias("id"))

    local = F.coalesce(
        F.when(F.size(m) != F.size(F.array_distinct(m)), fault(0, F.lit(""))),
        F.when(F.size(c) != F.size(F.array_distinct(c)), fault(1, F.lit(""))),
        F.when(F.size(F.array_except(m, c)) > 0, fault(2, F.array_min(F.array_except(m, c)))),
    )
    each = both.select("row", "source1_entity_id", F.posexplode("candidate_entity_ids").alias("at", "id"))
    absent = each.join(by_shuffle(known.select(F.col("entity_id").alias("id")).distinct()), "id", "left_anti")
    rule = F.when(F.col("id").rlike("^S[23]-"), 4).otherwise(3)
    one = each.where(~F.col("id").rlike("^S[23]-")).union(absent.select(each.columns)).select("row", "source1_entity_id", rule.alias("rule"), "at", "id")
    two = both.select("row", "source1_entity_id", local.alias("x")).where("x is not null").select("row", "source1_entity_id", "x.rule", F.lit(-1).alias("at"), "x.id")
    first = two.union(one).agg(F.min(F.struct("row", "at", "rule", "source1_entity_id", "id")).alias("e")).first()["e"]
    if first is not None:
        words = ("duplicate ids in the matches", "duplicate ids in the candidates", "a match outside the candidates: {}", "a candidate without the prefix S2- or S3-: {}", "a candidate that the sources don't have: {}")
        errors.append(f"{first['source1_entity_id']}: {words[first['rule']].format(first['id'])}")
    return errors
