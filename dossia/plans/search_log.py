"""Search for a whole log of phrases at once: many sets of conditions meet many cards by equality joins alone.

Each distinct test is made once, on the distinct values of its column: equal values and lengths by hash, parts of texts by their first letters, ranges by
an index of dyadic intervals. The rarest unit of a set of conditions (several equal or like conditions of a column are one unit)
names the candidates; the set's other units are tested on those alone. Of a set that has no other units, the first cards of each value suffice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dossia.operators.checkpoints import cut
from dossia.operators.joins import met
from dossia.plans.predicates import OPS

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
GRAM = 3
#: Bits of the number that stands for a value in the index of intervals: its order is the values' order, and what it can't tell apart is tested.
BITS = 48


def _numbers(kinds: dict[str, str]) -> list[str]:
    return [c for c, k in kinds.items() if k in NUMERIC or k.startswith("decimal")]


def _typed(column: Column, value: Column, numbers: list[str]) -> Column:
    """The value as it is compared: numbers as the text of a double, so that 7 and 07 are one; null if it isn't one."""
    return F.when(column.isin(numbers), value.try_cast("double").cast("string")).otherwise(value)


def condition_sets(parsed: DataFrame, phrases: DataFrame, kinds: dict[str, str], id_col: str = "phrase_id") -> DataFrame:
    """phrase_id, units (array of arrays of tests: columns, op, value) for each phrase; conditions of unknown columns or forms are left out.

    Words count only where a phrase has no condition: each must lie in some text column.
    """
    texts = [c for c, k in kinds.items() if k == "string"]
    columns = F.split("column", r"\|")
    known = F.forall(columns, lambda c: c.isin(list(kinds))) & F.col("op").isin(*OPS) & F.when(F.col("op") == "between", F.size("value") == 2).otherwise(F.size("value") == 1)
    test = lambda c, op, value: F.struct(c.alias("columns"), op.alias("op"), value.alias("value"))
    rows = parsed.select(id_col, "column", "op", "value", columns.alias("columns"), F.coalesce(known, F.lit(False)).alias("known"))
    # Alternatives share a unit; any other condition is a unit of its own.
    unit = F.concat_ws("\u0001", "column", "op", F.when(~F.col("op").isin("=", "like"), F.array_join("value", "\u0001")))
    conds = rows.where("known").groupBy(id_col, unit.alias("unit")).agg(F.array_sort(F.collect_set(test(F.col("columns"), F.col("op"), F.col("value")))).alias("tests"))
    conds = conds.groupBy(id_col).agg(F.array_sort(F.collect_list("tests")).alias("units"))
    word = F.array(test(F.array(*map(F.lit, texts)), F.lit("like"), F.array(F.upper(F.col("value")[0]))))
    words = rows.where(F.col("column").isNull()).groupBy(id_col).agg(F.array_sort(F.collect_set(word)).alias("words"))
    both = phrases.select(id_col).distinct().join(conds.hint("merge"), id_col, "left").join(words.hint("merge"), id_col, "left")
    units = F.coalesce("units", "words", F.array().cast(conds.schema["units"].dataType))
    typed = F.transform(units, lambda tests: F.transform(tests, lambda t: test(t["columns"], t["op"], F.when(t["op"] == "like", F.transform(t["value"], F.upper)).otherwise(t["value"]))))
    return both.select(F.col(id_col).alias("phrase_id"), typed.alias("units"))


def holds(value: Column, is_number: Column, op: Column, args: Column) -> Column:
    """Whether a card's value (as text) passes a test; null counts as no."""
    number, a, b = value.try_cast("double"), args[0], F.get(args, 1)

    def compared(x: Column, p: Column, q: Column) -> Column:
        out = F.when(op == "=", x == p).when(op == "<", x < p).when(op == ">", x > p).when(op == "<=", x <= p).when(op == ">=", x >= p)
        return out.when(op == "between", x.between(p, q))

    plain = F.when(is_number, compared(number, a.try_cast("double"), b.try_cast("double"))).otherwise(compared(value, a, b))
    return F.coalesce(F.when(op == "like", F.upper(value).contains(a)).when(op == "len", F.length(value) == a.try_cast("int")).otherwise(plain), F.lit(False))


def _order_key(value: Column, is_number: Column) -> Column:
    """A number of BITS bits that never falls as the value rises: whole numbers moved above 0, texts by their first bytes."""
    half = 2 ** (BITS - 1)
    number = F.least(F.greatest(F.floor(value.try_cast("double")), F.lit(-half)), F.lit(half - 1)).cast("long") + F.lit(half)
    text = F.conv(F.rpad(F.substring(F.hex(F.encode(value, "utf-8")), 1, BITS // 4), BITS // 4, "0"), 16, 10).cast("long")
    return F.when(is_number, number).otherwise(text)


def _ancestors(key: Column) -> Column:
    """The dyadic intervals that hold a number: level and place of each."""
    return F.transform(F.sequence(F.lit(0), F.lit(BITS)), lambda k: F.struct(k.cast("int").alias("level"), F.call_function("shiftright", key, k).alias("place")))


def _cover(low: Column, high: Column) -> Column:
    """The fewest dyadic intervals that cover the numbers from low to high: at most two on each level."""
    end = high + 1

    def level(k: Column) -> Column:
        left, right = F.call_function("shiftright", low + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k), F.call_function("shiftright", end, k)
        node = lambda use, place: F.when((left < right) & use, F.struct(k.cast("int").alias("level"), place.alias("place")))
        return F.array_compact(F.array(node(left % 2 == 1, left), node(right % 2 == 1, right - 1)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BITS)), level))


def matching_values(tests: DataFrame, values: DataFrame, numbers: list[str]) -> DataFrame:
    """column, op, value (of the test), held (the value of a card that passes) for distinct tests and distinct values of columns; no test meets a value but by equality."""
    is_number = F.col("column").isin(numbers)
    keys = ["column", "op", "value"]
    asked = tests.select("op", "column").distinct().collect()  # columns and operators at most
    known = lambda *ops: values.select("column", "held").where(F.col("column").isin([r.column for r in asked if r.op in ops]))
    same = tests.where("op = '='").withColumn("typed", _typed(F.col("column"), F.col("value")[0], numbers))
    equal = met(known("=").withColumn("typed", _typed(F.col("column"), F.col("held"), numbers)), same, ["column", "typed"])
    lengths = tests.where("op = 'len'").withColumn("size", F.col("value")[0].try_cast("int"))
    long = met(known("len").withColumn("size", F.length("held")), lengths, ["column", "size"])
    parts = tests.where("op = 'like'").withColumn("gram", F.substring(F.col("value")[0], 1, GRAM))
    sizes = F.array(*[F.lit(n) for n in range(1, GRAM + 1)])
    starts = lambda n: F.transform(F.sequence(F.lit(1), F.length("held") - n + 1), lambda i: F.substring(F.upper("held"), i, n))
    grams = F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.length("held")), starts)))
    # Only parts that a test begins with are sent.
    begun = met(known("like").withColumn("gram", F.explode(grams)), parts.select("column", "gram").distinct(), ["column", "gram"])
    like = met(begun, parts, ["column", "gram"]).where(F.upper("held").contains(F.col("value")[0]))
    top = F.lit(2**BITS - 1)
    a, b = _order_key(F.col("value")[0], is_number), _order_key(F.get("value", 1), is_number)
    low = F.when(F.col("op").isin(">", ">=", "between"), a).otherwise(F.lit(0).cast("long"))
    high = F.when(F.col("op").isin("<", "<="), a).when(F.col("op") == "between", b).otherwise(top)
    orders = ("<", ">", "<=", ">=", "between")
    ranges = tests.where(F.col("op").isin(*orders)).select(*keys, F.inline(_cover(low, high)))
    held = known(*orders).select("column", "held", F.inline(_ancestors(_order_key(F.col("held"), is_number))))
    within = met(held, ranges, ["column", "level", "place"]).where(holds(F.col("held"), is_number, F.col("op"), F.col("value")))
    found = [x.select(*keys, "held") for x in (equal, long, like, within)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).distinct()


def search_log(parsed: DataFrame, phrases: DataFrame, cards: DataFrame, id_col: str = "id", limit: int = 200, phrase_col: str = "phrase_id") -> DataFrame:
    """phrase_id, rank, card: the first ``limit`` cards by id that meet each phrase's conditions (as ``search`` finds them for one phrase).

    parsed: conditions and words as ``parse_phrases`` gives them. Phrases with the same conditions are searched once. A phrase without conditions or words finds
    the first cards of all; null values of cards meet no condition; ids of cards are unique.
    """
    kinds = {c: k for c, k in cards.dtypes if k in NUMERIC or k == "string" or k.startswith("decimal")}
    numbers = _numbers(kinds)
    asked = condition_sets(parsed, phrases, kinds, phrase_col)
    asked = cut(asked.withColumn("key", F.sha2(F.to_json("units"), 256)))
    sets = cut(asked.groupBy("key").agg(F.first("units").alias("units")).withColumn("set", F.monotonically_increasing_id()))

    units = sets.select("set", F.posexplode("units").alias("unit", "tests"))
    each = units.select("set", "unit", F.explode("tests").alias("t")).select("set", "unit", "t.op", "t.value", F.explode("t.columns").alias("column"))
    each = cut(each)
    tests = each.select("column", "op", "value").distinct()
    # Cards as rows of column and value, for columns that are asked for.
    used = [r.column for r in each.select("column").distinct().collect()]  # columns of the table at most
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("held")) for c in used])
    long = (cards.select(F.col(id_col).alias("card"), F.inline(entries)) if used else cards.select(F.col(id_col).alias("card"), F.lit("").alias("column"), F.lit("").alias("held"))).where("held is not null")
    values = cut(long.groupBy("column", "held").agg(F.count("*").alias("n")))
    passed = cut(matching_values(tests, values, numbers))
    held = cut(met(passed, each, ["column", "op", "value"]).select("set", "unit", "column", "held").distinct())

    # Sets of one unit: the first cards of each value that passes hold the first cards of all.
    several = cut(sets.where(F.size("units") > 1).select("set", "units"))
    numbered = lambda df, *by: df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("card"))).where(F.col("rank") <= limit)
    plain = held.join(several.select("set").hint("merge"), "set", "left_anti").select("set", "column", "held")
    plain = plain.join(numbered(long, "column", "held").drop("rank").hint("merge"), ["column", "held"]).select("set", "card").distinct()

    # The rarest unit of each other set; a unit that no card can meet ends the search.
    other = cut(met(held, several.select("set"), "set"))
    size = other.join(values.hint("merge"), ["column", "held"]).groupBy("set", "unit").agg(F.sum("n").alias("n"))
    size = units.join(several.select("set").hint("merge"), "set", "left_semi").select("set", "unit").join(size.hint("merge"), ["set", "unit"], "left").select("set", "unit", F.coalesce("n", F.lit(0)).alias("n"))
    rarest = cut(size.groupBy("set").agg(F.min(F.struct("n", "unit")).alias("r")).where("r.n > 0").select("set", F.col("r.unit").alias("unit")))
    chosen = cut(met(other, rarest, ["set", "unit"]).select("set", "column", "held"))
    candidates = met(long, chosen, ["column", "held"]).select("set", "card").distinct()

    # Its other units are tested on the candidates.
    row = F.create_map(*[x for c in used for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]) if used else F.create_map().cast("map<string,string>")
    whole = met(candidates.join(cards.select(F.col(id_col).alias("card"), row.alias("row")).hint("merge"), "card"), several, "set")
    passes = lambda t: F.exists(t["columns"], lambda c: holds(F.element_at("row", c), c.isin(numbers), t["op"], t["value"]))
    found = whole.where(F.forall("units", lambda tests: F.exists(tests, passes))).select("set", "card")
    first = cut(numbered(found.unionByName(plain), "set"))
    answered = asked.select("phrase_id", "key").join(sets.select("key", "set").hint("merge"), "key").join(first.hint("merge"), "set").select("phrase_id", "rank", "card")

    every = [r.card for r in cards.select(F.col(id_col).alias("card")).orderBy("card").limit(limit).collect()]  # limit rows
    all_of = F.posexplode(F.array(*map(F.lit, every))) if every else None
    if all_of is None:
        return answered
    free = asked.where(F.size("units") == 0).select("phrase_id", all_of.alias("rank", "card"))
    return answered.unionByName(free.select("phrase_id", (F.col("rank") + 1).alias("rank"), F.col("card").cast(cards.schema[id_col].dataType).alias("card")))
