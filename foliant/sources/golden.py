"""Question sets: golden items and multiple-choice items, from JSON of either known shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.pairs import paired
from foliant.sources.scratch import written

ITEM = (
    "id string, category string, difficulty string, question string, expected_answer string, source_pages array<int>, "
    "acceptable_answer_points array<string>, required_fact_groups array<array<string>>"
)
#: Short category names of older sets.
ALIASES = {"direct": "direct_fact_lookup", "definition": "definition_meaning", "numerical": "numerical_financial"}
CHOICE = "question string, category string, type string, mc1_targets struct<choices:array<string>,label:int>, best_answer string, incorrect_answers array<string>"


def items_of(payload: Column, tag: Column, source: Column) -> Column:
    """array of items of one file: a list, or an object with ``questions``."""
    whole = F.from_json(payload, _array(ITEM))
    wrapped = F.from_json(payload, f"questions {_array(ITEM)}")["questions"]
    items = F.when(F.ltrim(payload).startswith("["), whole).otherwise(wrapped)
    names = F.create_map(*[F.lit(x) for p in ALIASES.items() for x in p])
    fields = [c.strip().split(" ", 1)[0] for c in ITEM.split(", ")]

    def one(q: Column) -> Column:
        category = F.coalesce(F.try_element_at(names, q["category"]), q["category"], F.lit("unknown"))
        own = {"id": F.concat(tag, F.lit("_"), q["id"]), "category": category}
        return F.struct(*(own.get(f, q[f]).alias(f) for f in fields), source.alias("source_file"))

    return F.transform(items, one)


def _array(ddl: str) -> str:
    inner = ",".join(":".join(c.strip().split(" ", 1)) for c in ddl.split(", "))
    return f"array<struct<{inner}>>"


def load(spark: SparkSession, specs: dict[str, str]) -> DataFrame:
    """Items of several files (path to the document they ask about), ids prefixed by the file's tag."""
    out = None
    for path, source in specs.items():
        tag = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].replace("golden_dataset_", "d")
        text = spark.read.text(path, wholetext=True)
        rows = text.select(F.explode(items_of(F.col("value"), F.lit(tag), F.lit(source))).alias("i")).select("i.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def choices_of(record: Column) -> Column:
    """question, category, type, choices, label of a multiple-choice record in either shape; null if unusable."""
    r = F.from_json(record, CHOICE)
    wrong = F.filter(r["incorrect_answers"], lambda a: a.isNotNull() & (F.trim(a) != "") & (a != r["best_answer"]))
    given = F.coalesce(F.size(r["mc1_targets"]["choices"]) > 0, F.lit(False))
    made = F.coalesce((r["best_answer"] != "") & (F.size(wrong) > 0), F.lit(False))
    choices = F.when(given, r["mc1_targets"]["choices"]).when(made, F.concat(F.array(r["best_answer"]), wrong))
    label = F.when(given, r["mc1_targets"]["label"]).when(made, 0)
    usable = F.coalesce(r["question"] != "", F.lit(False)) & choices.isNotNull()
    return F.when(usable, F.struct(r["question"].alias("question"), r["category"].alias("category"), r["type"].alias("type"), choices.alias("choices"), label.alias("label")))


def sampled(items: DataFrame, limit: int, seed: int, question: str = "question", *ties: str) -> DataFrame:
    """``limit`` items (0: all) in an order drawn from the seed and the question, then by ``ties``: the same in any run."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(question, F.lit(""))))
    return items.orderBy(drawn, question, *ties).limit(limit) if limit > 0 else items


def about(items: DataFrame, document: str, chunks: DataFrame, gold_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The items about one document and its chunks; ``gold_only`` keeps the chunks of the items' source pages."""
    mine, held = items.where(F.col("source_file") == document), chunks.where(F.col("filename") == document)
    if not gold_only:
        return mine, held
    pages = mine.select("id", F.explode("source_pages").alias("page_number"))
    return mine, pages.join(held, "page_number")


#: Items or pages of a key that meet in one group.
BLOCK = 4096


def opened(items: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Every item with every page of its keys: blocks of items as lists, through which pages step."""
    told = written(items.withColumn("_item", F.monotonically_increasing_id()), "gold-items")
    return paired(pages, told, keys, BLOCK, max(1, BLOCK // 8), "_item").select(*items.columns, *(c for c in pages.columns if c not in keys))
