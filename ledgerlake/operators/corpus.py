"""Script corpus: path filters, ordered rules, manifests and name reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import naming, paths, scalar
from ledgerlake.operators.skew import join_aggregated
from ledgerlake.session import materialize

# Fixed values.
SCRIPT_SUFFIXES = (".sql", ".sql.tmpl")
COMMENT = "#"


def scripts(files: DataFrame, path: str = "path", suffixes: Sequence[str] = SCRIPT_SUFFIXES, ordered: bool = True) -> DataFrame:
    """Files with a script suffix, in path order unless that is off."""
    test = F.lit(False)
    for suffix in suffixes:
        test = test | F.endswith(F.col(path), F.lit(suffix))
    return files.where(test).orderBy(path) if ordered else files.where(test)


def fingerprinted(files: DataFrame, content: str = "content", name: str = "checksum") -> DataFrame:
    return files.withColumn(name, scalar.content_hash(F.col(content)))


def filter_paths(
    files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), path: str = "path", base: str = ""
) -> DataFrame:
    """Files at or below an included prefix and no excluded one; no include means all, and exclude wins."""
    relative = paths.relative_to(F.col(path), base) if base else F.col(path)
    test = paths.under_any(relative, include) if include else F.lit(True)
    return files.where(test & ~paths.under_any(relative, exclude))


def filter_paths_by_rules(files: DataFrame, rules: DataFrame, path: str = "path", salts: int = 16) -> DataFrame:
    """As :func:`filter_paths`, for a rule table (``prefix, action``) of any size.

    A prefix test against a table would be a theta join. Instead every distinct path is expanded to its ancestors,
    which meet the rules by equality. Top-level ancestors are shared by many paths, so the join key is salted with the
    path's hash and the rules are repeated per salt.
    """
    salt = F.pmod(F.xxhash64("__path"), F.lit(salts)).cast("int")
    expanded = (
        files.select(F.col(path).alias("__path")).distinct()
        .select("__path", salt.alias("__salt"), F.explode(paths.ancestors(paths.normalize(F.col("__path")))).alias("__prefix"))
    )
    repeated = rules.select(paths.normalize(F.col("prefix")).alias("__prefix"), "action").distinct()
    any_include = repeated.agg(F.coalesce(F.max(F.col("action") == "include"), F.lit(False)).alias("x"))
    repeated = repeated.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    verdicts = (
        expanded.join(repeated, ["__prefix", "__salt"])
        .groupBy("__path")
        .agg(F.max(F.col("action") == "include").alias("__in"), F.max(F.col("action") == "exclude").alias("__out"))
    )
    judged = join_aggregated(files, verdicts.withColumnRenamed("__path", path), [path])
    included = F.coalesce(F.col("__in"), F.lit(False)) | ~any_include.scalar()
    kept = judged.where(included & ~F.coalesce(F.col("__out"), F.lit(False)))
    return kept.select(*files.columns)


def evaluate_rules(rules: DataFrame, seq: str = "seq") -> DataFrame:
    """Ordered rules (``seq, include[], exclude[]``) to one action per path.

    A later rule moves a path between include and exclude; inside one rule excludes are applied last.
    """
    moves = rules.select(F.col(seq), F.explode("include").alias("prefix"), F.lit(0).alias("__step")).unionByName(
        rules.select(F.col(seq), F.explode("exclude").alias("prefix"), F.lit(1).alias("__step"))
    )
    action = F.when(F.col("__step") == 0, "include").otherwise("exclude")
    return moves.groupBy("prefix").agg(F.max_by(action, F.struct(F.col(seq), F.col("__step"))).alias("action"))


def merge_base_rules(base: DataFrame, evaluated: DataFrame) -> DataFrame:
    """A base list (``prefix, action``) changed by evaluated rules: the rule's action replaces the base one."""
    ranked = base.select("prefix", "action", F.lit(0).alias("__rank")).unionByName(
        evaluated.select("prefix", "action", F.lit(1).alias("__rank"))
    )
    excluded = F.col("action") == "exclude"
    return ranked.groupBy("prefix").agg(F.max_by("action", F.struct(F.col("__rank"), excluded)).alias("action"))


def matching_rules(rules: DataFrame, facts: dict) -> DataFrame:
    """Rules whose every stated condition (columns ``match_<fact>``, null = not stated) equals the given fact."""
    test = F.lit(True)
    for name in [c for c in rules.columns if c.startswith("match_")]:
        fact = F.lit(facts.get(name.removeprefix("match_")))
        test = test & (F.col(name).isNull() | F.coalesce(F.col(name) == fact, F.lit(False)))
    return rules.where(test)


def effective_paths(files: DataFrame, rules: DataFrame, facts: dict, base: DataFrame, path: str = "path") -> DataFrame:
    """Files that stay under the rules that match the facts, evaluated in order and laid over the base lists (``prefix, action``)."""
    return filter_paths_by_rules(files, merge_base_rules(base, evaluate_rules(matching_rules(rules, facts))), path)


def discover_changes(files: DataFrame, base: str = "changes", path: str = "path") -> DataFrame:
    """Changes of a folder tree, from its file paths: ``name, date, description, change_files, revert_files, has_revert, has_changelog,
    valid, error``.

    A change is a folder below ``base``; its scripts and manifests lie in ``change`` and ``revert``. Without any it is not valid.
    Paths are counted per task before the shuffle; files that lie elsewhere make a folder a change but count for nothing.
    """
    inner = paths.relative_to(F.col(path), base)
    name, place = F.regexp_extract(inner, "^([^/]+)/", 1), F.regexp_extract(inner, "^[^/]+/(change|revert)/[^/]+$", 1)
    script = F.col("file").rlike(naming.SCRIPT_SUFFIX)
    found = files.select(name.alias("name"), place.alias("place"), inner.alias("file")).where(F.col("name") != "")
    changes = found.groupBy("name").agg(
        F.count_if(script & (F.col("place") == "change")).alias("change_files"),
        F.count_if(script & (F.col("place") == "revert")).alias("revert_files"),
        F.max(F.col("file") == F.concat("name", F.lit("/changelog.md"))).alias("has_changelog"),
    )
    valid = F.col("change_files") + F.col("revert_files") > 0
    return changes.select(
        "name",
        naming.change_date(F.col("name")).alias("date"),
        naming.change_description(F.col("name")).alias("description"),
        "change_files",
        "revert_files",
        (F.col("revert_files") > 0).alias("has_revert"),
        "has_changelog",
        valid.alias("valid"),
        F.when(~valid, "Must have at least change/ or revert/ folder with files").alias("error"),
    )


def manifest_paths(manifests: DataFrame, key: str = "manifest", content: str = "content") -> DataFrame:
    """Paths a manifest lists: one per line, comments and blank lines left out, sorted."""
    lines = manifests.select(key, F.explode(F.split(content, "\n")).alias("__line"))
    lines = lines.select(key, F.regexp_replace("__line", r"^\s+|\s+$", "").alias("path"))
    return lines.where((F.col("path") != "") & ~F.startswith(F.col("path"), F.lit(COMMENT))).orderBy(key, "path")


def manifest_errors(manifests: DataFrame, files: DataFrame, key: str = "manifest", content: str = "content") -> DataFrame:
    """Manifests that list nothing, and references to files that do not exist.

    Each listed path is looked up once, however many manifests list it; only missing ones meet the manifests again, with an
    exchange on both sides, which Spark splits.
    """
    listed = manifest_paths(manifests, key, content)
    empty = manifests.select(key).join(listed.select(key).distinct(), key, "left_anti")
    unknown = listed.select("path").distinct().join(files.select("path").distinct(), "path", "left_anti")
    missing = listed.join(materialize(unknown, "missing-paths"), "path", "left_semi")
    return empty.select(key, F.lit(None).cast("string").alias("path"), F.lit("empty").alias("error")).unionByName(
        missing.select(key, "path", F.lit("missing").alias("error"))
    )


def parsed_names(files: DataFrame, name: str = "name") -> DataFrame:
    """Change names with their date and description."""
    return files.select(
        "*",
        naming.change_date(F.col(name)).alias("change_date"),
        naming.change_description(F.col(name)).alias("description"),
    )


def duplicate_sequences(files: DataFrame, keys: Sequence[str], filename: str = "filename") -> DataFrame:
    """Sequence numbers used more than once in a folder."""
    numbered = files.select(*keys, naming.file_sequence(F.col(filename)).alias("sequence"))
    counted = numbered.where(F.col("sequence").isNotNull()).groupBy(*keys, "sequence").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > 1)


def key_collisions(files: DataFrame, filename: str = "filename") -> DataFrame:
    """Context keys that more than one file name maps to: one file would silently replace the other."""
    keyed = files.select(naming.context_key(F.col(filename)).alias("context_key"), F.col(filename).alias("__f"))
    counted = keyed.distinct().groupBy("context_key").agg(F.count(F.lit(1)).alias("files"))
    return counted.where(F.col("files") > 1)
