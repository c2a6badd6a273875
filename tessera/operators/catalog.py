"""Schema snapshots: comparison, search, usage, hashes of source lines, and sync scripts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def columns_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, position, data_type, nullable) of the given tables."""
    rows = [(t, f.name, i + 1, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int, data_type string, nullable boolean")


def compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status (a_only, b_only, changed, same) and the names of what differs."""
    rest = [c for c in a.columns if c not in keys]
    left = a.select(*keys, F.struct(*rest).alias("_a"))
    right = b.select(*keys, F.struct(*rest).alias("_b"))
    both = left.join(right, keys, "full")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in rest]))
    status = F.when(F.col("_b").isNull(), "a_only").when(F.col("_a").isNull(), "b_only").when(F.size(differs) > 0, "changed").otherwise("same")
    return both.select(*keys, status.alias("status"), F.when(status == "changed", F.array_join(differs, ",")).otherwise("").alias("differs"))


def compare_all(a: dict[str, DataFrame], b: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """(kind, object, status, differs) over all kinds of objects of two snapshots (columns, constraints, indexes, views, sequences, code): each kind by its
    key columns, which make the object's name; a kind that one side lacks is empty there.
    """
    out = None
    for kind in sorted(set(a) | set(b)):
        left, right = a.get(kind), b.get(kind)
        left = right.limit(0) if left is None else left
        right = left.limit(0) if right is None else right
        found = compare(left, right, keys[kind]).select(F.lit(kind).alias("kind"), F.concat_ws(".", *keys[kind]).alias("object"), "status", "differs")
        out = found if out is None else out.unionByName(found)
    return out


def constraints(columns: DataFrame, primary: DataFrame, unique: DataFrame | None = None) -> DataFrame:
    """(table_name, definition): not-null checks of columns, primary keys and unique keys (table_name, column_name, position), by definition, names apart."""
    listed = lambda df, word: df.groupBy("table_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", F.upper("column_name").alias("c")))), lambda x: x["c"]), ", ").alias("c")).select("table_name", F.concat(F.lit(f"{word} ("), "c", F.lit(")")).alias("definition"))
    out = listed(primary, "PRIMARY KEY")
    keyed = primary.select(F.col("table_name").alias("_t"), F.col("column_name").alias("_c"))
    checks = columns.filter("NOT nullable").join(keyed, (F.col("table_name") == F.col("_t")) & (F.col("column_name") == F.col("_c")), "left_anti")
    out = out.unionByName(checks.select("table_name", F.concat(F.upper("column_name"), F.lit(" IS NOT NULL")).alias("definition")))
    return out.unionByName(listed(unique, "UNIQUE")) if unique is not None else out


def definition_key(c: str) -> Column:
    """Definitions of unnamed constraints: upper case, one space."""
    return F.upper(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")))


def source_hash(lines: DataFrame, unit: str, line: str, text: str) -> DataFrame:
    """(unit, n_lines, source_hash): trailing blanks don't count, the order of lines does. A sum over lines, so that no task holds a source."""
    one = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(line).cast("string"), F.rtrim(F.coalesce(F.col(text), F.lit(""))))), 1, 15), 16, 10).cast("decimal(38,0)")
    return lines.groupBy(unit).agg(F.count("*").alias("n_lines"), F.sum(one).cast("string").alias("source_hash"))


def join_conditions(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(child, parent, condition): joins that column names suggest. `columns` is of `columns_of`, `keys` has (table_name, column_name) of one-column keys;
    a column of another table refers to a key of the same name after its table's prefix, if it isn't its own table's key.
    """
    bare = F.regexp_replace("column_name", "^[a-z]+_", "")
    parent = keys.select(F.col("table_name").alias("parent"), F.col("column_name").alias("pk"), bare.alias("_bare")).distinct()
    child = columns.select(F.col("table_name").alias("child"), F.col("column_name").alias("fk"), bare.alias("_name"))
    return child.join(parent, F.col("_name") == F.col("_bare")).filter("child <> parent").select("child", "parent", F.concat("fk", F.lit(" = "), "pk").alias("condition"))


def rewrite_owner(text: Column, old: str, new: str) -> Column:
    """Code with `old.` as an owner of names replaced, whole words only, quoted or not."""
    name = re.escape(old)
    return F.regexp_replace(text, rf'(?i)(?<![\w$#."]){name}(?=\s*\.)|"{name}"(?=\s*\.)', new.replace("\\", "\\\\").replace("$", "\\$"))


def column_usage(column: str, lines: DataFrame, uses: DataFrame, synonyms: DataFrame, table: str) -> DataFrame:
    """(unit, how, line, text): the units that use a table directly or through a synonym, with the lines that name a column; units that name it nowhere stand once, with null.

    lines: (unit, line, text); uses: (unit, name); synonyms: (synonym, table_name).
    """
    names = synonyms.filter(F.upper("table_name") == table.upper()).select(F.upper("synonym").alias("_name"), F.lit("synonym").alias("how"))
    names = names.unionByName(uses.sparkSession.createDataFrame([(table.upper(), "direct")], "_name string, how string"))
    users = uses.join(names, F.upper("name") == F.col("_name")).groupBy("unit").agg(F.min("how").alias("how"))
    word = rf"(?i)(?<![\w$#]){re.escape(column)}(?![\w$#])"
    said = lines.filter(F.col("text").rlike(word)).select(F.col("unit").alias("_u"), "line", "text")
    return users.join(said, F.col("unit") == F.col("_u"), "left").select("unit", "how", "line", "text")


def dependencies(name: str, uses: DataFrame, synonyms: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """(direction, object, hows): what uses an object (directly, through a synonym, by a foreign key) and what it uses, once each with all the ways.

    uses: (unit, name); synonyms: (synonym, table_name); foreign_keys: (child, parent).
    """
    up = lambda c: F.upper(F.col(c))
    own = name.upper()
    alias = synonyms.filter(up("table_name") == own).select(up("synonym").alias("_s")).distinct()
    rows = uses.filter(up("name") == own).select(F.lit("used_by").alias("direction"), F.col("unit").alias("object"), F.lit("direct").alias("how"))
    rows = rows.unionByName(uses.join(alias, up("name") == F.col("_s"), "left_semi").select(F.lit("used_by").alias("direction"), F.col("unit").alias("object"), F.lit("synonym").alias("how")))
    rows = rows.unionByName(foreign_keys.filter(up("parent") == own).select(F.lit("used_by").alias("direction"), F.col("child").alias("object"), F.lit("foreign key").alias("how")))
    rows = rows.unionByName(uses.filter(up("unit") == own).select(F.lit("uses").alias("direction"), F.col("name").alias("object"), F.lit("direct").alias("how")))
    rows = rows.unionByName(foreign_keys.filter(up("child") == own).select(F.lit("uses").alias("direction"), F.col("parent").alias("object"), F.lit("foreign key").alias("how")))
    return rows.groupBy("direction", "object").agg(F.array_join(F.sort_array(F.collect_set("how")), ",").alias("hows"))


def resolve_synonyms(names: DataFrame, synonyms: DataFrame, most: int = 8) -> DataFrame:
    """Adds `target` to names (name): what it stands for after at most `most` synonyms (synonym, table_name); itself if it is none, null in a cycle or beyond."""
    links = synonyms.select(F.col("synonym").alias("_s"), F.col("table_name").alias("_t")).dropDuplicates(["_s"])
    now = names.withColumn("target", F.col("name"))
    for _ in range(most):
        now = now.join(links, F.col("target") == F.col("_s"), "left").withColumn("target", F.coalesce("_t", "target")).drop("_s", "_t")
    still = now.join(links, F.col("target") == F.col("_s"), "left")
    return still.withColumn("target", F.when(F.col("_s").isNull(), F.col("target"))).drop("_s", "_t")


#: The order in which kinds of objects are changed by a script, and undone.
SCRIPT_ORDER = ("sequence", "table", "column", "index", "primary key", "unique", "check", "view", "code", "foreign key")


def script_order(kind: Column) -> Column:
    """Where a kind stands in a script; unknown kinds come last."""
    place = F.array_position(F.array(*[F.lit(k) for k in SCRIPT_ORDER]), F.lower(kind))
    return F.when(place > 0, place).otherwise(len(SCRIPT_ORDER) + 1).cast("int")


def normal_default(text: Column) -> Column:
    """A default's text without outer blanks, upper-case outside quotes."""
    parts = F.split(F.trim(text), "'")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.upper(p)).otherwise(p)), "'")


def normal_view(text: Column) -> Column:
    """A view's text to compare: upper-case, lines without trailing blanks."""
    return F.trim(F.regexp_replace(F.upper(text), r"[ \t\r]+(?=\n|$)", ""))


def search(df: DataFrame, words: list[str], name: str, columns: str) -> DataFrame:
    """Score of rows (name, array of column names): 3 for each word in the name, and up to 5 for columns that hold one."""
    upper = F.upper(F.col(name))
    in_name = reduce(lambda a, b: a + b, [F.when(upper.contains(w.upper()), 1).otherwise(0) for w in words])
    in_columns = F.size(F.filter(F.col(columns), lambda c: reduce(lambda a, b: a | b, [F.upper(c).contains(w.upper()) for w in words])))
    return df.withColumn("score", (in_name * 3 + F.least(in_columns, F.lit(5))).cast("long")).filter("score > 0")


def name_score(name: Column, asked: str) -> Column:
    """How well a name answers what was typed: exact, prefix, word boundary, initials, contains."""
    n, q = F.upper(name), F.lit(asked.upper())
    initials = F.regexp_replace(n, r"([A-Z0-9])[A-Z0-9]*_?", "$1")
    return (
        F.when(n == q, 1100).when(n.startswith(q), 1000 - F.least(F.length(n) - F.length(q), F.lit(200))).when(F.concat(F.lit("_"), n).contains(F.concat(F.lit("_"), q)), 600).when(initials.startswith(q), 500).when(n.contains(q), 400).otherwise(0)
    )


def sync_script(compared: DataFrame, columns: DataFrame) -> DataFrame:
    """DDL lines that bring b to a; what would lose data is a comment."""
    both = compared.join(columns, ["table_name", "column_name"], "left")
    add = F.concat(F.lit("ALTER TABLE "), "table_name", F.lit(" ADD COLUMN "), "column_name", F.lit(" "), "data_type", F.lit(";"))
    change = F.concat(F.lit("ALTER TABLE "), "table_name", F.lit(" ALTER COLUMN "), "column_name", F.lit(" TYPE "), "data_type", F.lit(";"))
    drop = F.concat(F.lit("-- ALTER TABLE "), "table_name", F.lit(" DROP COLUMN "), "column_name", F.lit(";"))
    return both.filter("status <> 'same'").select("table_name", "column_name", F.when(F.col("status") == "a_only", add).when(F.col("status") == "changed", change).otherwise(drop).alias("line"))


def used_in_lines(lines: DataFrame, word: str, text: str = "text") -> DataFrame:
    """Lines that hold a whole word, and whether only in a comment."""
    whole = rf"(?i)(?<![\w$#]){re.escape(word)}(?![\w$#])"
    code = F.regexp_replace(F.col(text), "--.*$", "")
    return lines.filter(F.col(text).rlike(whole)).withColumn("only_comment", ~code.rlike(whole))


def tagged(parts: dict[str, DataFrame]) -> DataFrame:
    """Facts of different shapes in one table: a tag beside the columns of all, null where a part has none."""
    out = None
    for tag, df in parts.items():
        own = df.select(F.lit(tag).alias("tag"), "*")
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def folder_usage(spark: SparkSession, path: str) -> DataFrame:
    """(folder, n_files, bytes, share) of the files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    by = files.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))
    total = by.agg(F.sum("bytes").alias("_all"))
    return by.join(F.broadcast(total)).select("folder", "n_files", "bytes", (F.col("bytes") / F.col("_all")).alias("share"))


def unknown_columns(sql: str, known: DataFrame) -> DataFrame:
    """(table_name, column_name): qualified columns of a query that no table of the catalog (table_name, column_name) has; names made by AS are known."""
    from ..plans.lexer import tokens

    ts = tokens(sql)
    made = {b.up for a, b in zip(ts, ts[1:], strict=False) if a.up == "AS"} | {a.up for a, b in zip(ts, ts[1:], strict=False) if b.up == "AS" and a.kind == "word"}
    pairs = sorted({(a.up, c.up) for a, b, c in zip(ts, ts[1:], ts[2:], strict=False) if b.text == "." and a.kind == c.kind == "word" and c.up not in made and c.up not in ("NEXTVAL", "CURRVAL")})
    spark = known.sparkSession
    asked = spark.createDataFrame(pairs, "table_name string, column_name string") if pairs else spark.createDataFrame([], "table_name string, column_name string")
    names = known.select(F.upper("column_name").alias("_c")).union(known.select(F.upper("table_name"))).distinct()
    return asked.join(names, F.col("column_name") == F.col("_c"), "left_anti")
