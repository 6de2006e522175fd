"""The queries over interaction tables, and the DuckDB SQL that each must equal.

The operators are those of a self-assessment page; the tables put real numbers of
rows under them: events stand in for clicks, parts for counters, pages for links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, numbers, records
from ..operators import interaction
from ..sources import relations
from ..sources.tables import load
from .sql import ORACLE_SQL  # noqa: F401

USES = relations.QUESTIONS[0][3]
SCOPES = ("Yes", "No", "Not sure", "")


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def _picked(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(_words(values), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as clicks on the first question's options."""
    return load(spark, sf_dir, "events").withColumn("option", _picked(USES, F.col("event_id")))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = interaction.multi_select(_clicks(spark, sf_dir), option="option")
    return chosen.withColumn("in_scope", _picked(SCOPES, F.col("user_id")))


def r01_multi_select_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.multi_select(load(spark, sf_dir, "events")).select("user_id", F.array_join("selected", ",").alias("selected"))


def r02_single_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.single_select(load(spark, sf_dir, "events"))


def r03_rule_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("user_id", "in_scope", answers.classify("selected", "in_scope").alias("result"))


def r04_any_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("user_id", answers.any_of("selected", relations.HIGH_RISK_USES).alias("any_high_risk"))


def r05_array_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R05, R06, R07: test, drop, append, and the toggle that joins them."""
    option = F.lit(USES[0])
    return _answers(spark, sf_dir).select(
        "user_id",
        answers.has("selected", option).alias("has_option"),
        F.array_join(answers.without("selected", option), ";").alias("dropped"),
        F.array_join(F.array_append("selected", option), ";").alias("appended"),
        F.array_join(answers.toggled("selected", option), ";").alias("toggled"),
    )


def r08_can_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir)
    return rows.select(
        "user_id",
        answers.is_complete(F.lit(True), "selected", "in_scope").alias("uses_complete"),
        answers.is_complete(F.lit(False), "selected", "in_scope").alias("scope_complete"),
    )


def r09_is_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, multi = _answers(spark, sf_dir), F.col("user_id") % 2 == 0
    return rows.select("user_id", answers.is_selected(multi, "selected", "in_scope", F.when(multi, USES[1]).otherwise("Yes")).alias("is_selected"))


def r10_step_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "click", "next").when(kind == "view", "back").when(kind == "error", "reset").otherwise("none")
    return interaction.step_machine(load(spark, sf_dir, "events").withColumn("action", action)).select("user_id", "state")


def r11_days_until_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", numbers.days_until(numbers.utc(F.col("ts"))).alias("days_left"))


def r12_result_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole self-assessment: toggled answers, the rules, and what is shown."""
    return interaction.look_up(r03_rule_classifier(spark, sf_dir), relations.results(spark), "result").select("user_id", "result", "heading", "link")


def _target() -> Column:
    """Part sizes as counters: some with a plus, some with more than a counter has."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    return F.when(key % 4 == 0, F.concat(size, F.lit("+"))).when(key % 4 == 1, size).when(key % 4 == 2, F.concat(size, F.lit("\n"))).otherwise(F.col("p_name"))


def r13_parse_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R13, R14: digits and an optional plus, to the end of the text."""
    rows = load(spark, sf_dir, "part").withColumn("target", _target())
    return rows.select("p_partkey", numbers.counter_number(F.col("target")).alias("number"), numbers.counter_suffix(F.col("target")).alias("suffix"))


def r15_ease_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", numbers.eased(F.col("l_quantity") * 40.0, F.col("l_extendedprice")).alias("shown"))


def r16_still_or_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").withColumn("target", _target())
    still, elapsed = F.col("p_partkey") % 3 == 0, (F.col("p_partkey") % 13) * 100.0
    return rows.select("p_partkey", numbers.counter_text(F.col("target"), elapsed, still).alias("display"))


def r17_one_shot_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.latch(load(spark, sf_dir, "events"), F.col("value") >= 15)


def r18_delayed_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events")
    due = numbers.delayed(numbers.utc(F.col("ts")), (F.col("event_id") % 7) * 80)
    return rows.select("event_id", F.unix_micros(due).alias("due_micros"))


def r19_threshold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.threshold_state(load(spark, sf_dir, "events"), F.col("value") > 15)


def r20_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.flip(load(spark, sf_dir, "events").where("event_type = 'click'"))


def r21_class_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.array(F.lit("page"), F.col("o_orderpriority"))
    locked = F.col("o_orderstatus") == "O"
    once = records.with_class(start, "locked", locked)
    return load(spark, sf_dir, "orders").select("o_orderkey", F.array_join(records.with_class(once, "locked", locked), " ").alias("classes"))


def r22_link_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    hrefs = tuple(h for h, _ in relations.LINKS)
    rows = load(spark, sf_dir, "pages").select("page_id", _picked(hrefs, F.col("page_id")).alias("path"), F.explode(_words(hrefs)).alias("href"))
    return rows.select("page_id", "href", records.link_style(F.col("path"), F.col("href"), F.col("page_id") % 2 == 0).alias("style"))


def r23_query_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", records.query_flag(F.col("url"), "page", "2").alias("is_second_page"))


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as people who write: some without an address, some robots."""
    key = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(key % 11 == 0, "").otherwise(F.col("c_name")).alias("name"),
        F.when(key % 7 == 0, F.concat(F.col("c_name"), F.lit("@"))).otherwise(F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")), F.lit("@mail.example"))).alias("email"),
        F.lit("").alias("organisation"),
        F.when(key % 5 == 0, " ").when(key % 13 == 0, "").otherwise(F.col("c_mktsegment")).alias("message"),
        F.when(key % 17 == 0, "x").otherwise("").alias("bot_field"),
        F.lit("contact").alias("form_name"),
    )


def r24_required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _submissions(spark, sf_dir).select("c_custkey", records.is_email(F.col("email")).alias("email_ok"), records.is_valid_submission().alias("is_valid"))


def r25_form_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.forms import accepted

    return accepted(_submissions(spark, sf_dir)).select("c_custkey", "name", "email", "message", "form_name")


def r26_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as an entry of a list: its number, its label, and where it leads."""
    number = F.col("p_partkey") + 1
    return load(spark, sf_dir, "part").select(number.alias("number"), F.upper("p_name").alias("label"), F.concat(F.lit("/parts/"), number.cast("string")).alias("href"))


def r27_indexed_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    i = F.col("i")
    return rows.select("vec_id", "i", (i * 80).alias("delay_ms"), records.bar_colour(i).alias("colour"), records.bar_opacity(i).alias("opacity"))


def r27_union_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (load(spark, sf_dir, t).select((F.col(k) - least).alias("i"), F.col(n).alias("name")) for t, k, n, least in (("region", "r_regionkey", "r_name", 0), ("nation", "n_nationkey", "n_name", 0)))
    return interaction.indexed_union(first, second, 5).select("i", (F.col("i") * 80).alias("delay_ms"), "name")


def r28_positional_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 6).alias("step"))
    return rows.select("event_id", answers.at(_words(tuple(q[0] for q in relations.QUESTIONS)), F.col("step")).alias("question"))


def r29_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = records.to_record_json({"user": F.col("user_id"), "kind": F.col("event_type"), "place": F.struct(F.lit(None).cast("string").alias("zip"), F.lit("").alias("phone"))})
    return load(spark, sf_dir, "events").select("event_id", made.alias("json"))


def r30_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.col("ts")
    text = F.format_string("%s visitor %d in %d", records.or_default(F.nullif("event_type", F.lit("view")), F.lit("unknown")), F.col("user_id"), F.year(now))
    return load(spark, sf_dir, "events").select("event_id", text.alias("line"), F.year(now).alias("year"))


FLAGSHIP = "r12_result_lookup"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f in list(globals().items()) if name[0] == "r" and name[1:3].isdigit()}
