"""Merging the readings of two engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxloom.settings import Settings


def choose_primary(results: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """M1-M4: a row per document: text and conf by engine (null without one), primary, avg_confidence, engines_used.

    One engine passes through; of two the one of higher weighted confidence is
    primary, the box engine on a tie. Documents without results have no row.
    """
    pick = lambda engine, column: F.max(F.when(F.col("engine") == engine, F.col(column)))
    rows = results.groupBy("rx_id").agg(*[pick(e, c).alias(f"{e}_{c}") for e in ("box", "word") for c in ("text", "avg_conf")])
    box, word = F.col("box_avg_conf") * settings.box_weight, F.col("word_avg_conf") * settings.word_weight
    both = F.col("box_avg_conf").isNotNull() & F.col("word_avg_conf").isNotNull()
    primary = F.when(F.col("word_avg_conf").isNull() | (both & (box >= word)), "box").otherwise("word")
    conf = F.when(both, box + word).otherwise(F.coalesce("box_avg_conf", "word_avg_conf"))
    used = F.when(both, F.array(F.lit("box"), F.lit("word"))).otherwise(F.array(primary))
    return rows.withColumns({"primary_engine": primary, "avg_confidence": conf, "engines_used": used})


def line_similarity(a: Column, b: Column) -> Column:
    """M5: one less the edit distance, in lower case, over the longer length; 0 for an empty line."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(F.lower(a), F.lower(b)) / longest)


def aligned(primary: Column, secondary: Column) -> Column:
    """M6, M7: the lines of ``primary`` (array of struct<text, conf>), each replaced by its partner if that is surer.

    In order, a line's partner is the most similar line of ``secondary`` that is
    not taken, the first among equals, if their similarity is over 0.5. Taken
    it is either way.
    """

    def step(acc: Column, p: Column) -> Column:
        def closer(best: Column, i: Column) -> Column:
            sim = F.when(F.array_contains(acc["used"], i), 0.0).otherwise(line_similarity(p["text"], F.get(secondary, i)["text"]))
            return F.when(sim > best["sim"], F.struct(sim.alias("sim"), i.alias("at"))).otherwise(best)

        none = F.struct(F.lit(0.0).alias("sim"), F.lit(-1).alias("at"))
        best = F.when(F.size(secondary) > 0, F.aggregate(F.sequence(F.lit(0), F.size(secondary) - 1), none, closer)).otherwise(none)
        partner = F.get(secondary, best["at"])
        taken = best["sim"] > 0.5
        text = F.when(taken & (partner["conf"] > p["conf"]), partner["text"]).otherwise(p["text"])
        used = F.when(taken, F.concat(acc["used"], F.array(best["at"]))).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.concat(acc["out"], F.array(text)).alias("out"))

    start = F.struct(F.expr("cast(array() as array<int>)").alias("used"), F.expr("cast(array() as array<string>)").alias("out"))
    return F.aggregate(primary, start, step, lambda acc: acc["out"])


def merged_texts(results: DataFrame, blocks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """M1-M7: rx_id, text, avg_confidence, engines_used, primary_engine.

    ``results`` has one variant per document and engine, ``blocks`` their lines
    (rx_id, engine, line_num, text, confidence).
    """
    rows = choose_primary(results, settings)
    lines = blocks.filter(F.trim("text") != "").groupBy("rx_id", "engine").agg(F.array_sort(F.collect_list(F.struct("line_num", "text", F.col("confidence").alias("conf")))).alias("l"))
    plain = F.transform("l", lambda x: F.struct(x["text"].alias("text"), x["conf"].alias("conf")))
    by = lines.groupBy("rx_id").agg(*[F.max(F.when(F.col("engine") == e, plain)).alias(f"{e}_lines") for e in ("box", "word")])
    rows = rows.join(by, "rx_id", "left")
    empty = F.expr("cast(array() as array<struct<text:string,conf:double>>)")
    first = F.when(F.col("primary_engine") == "box", F.col("box_lines")).otherwise(F.col("word_lines"))
    second = F.when(F.col("primary_engine") == "box", F.col("word_lines")).otherwise(F.col("box_lines"))
    own = F.when(F.col("primary_engine") == "box", F.col("box_text")).otherwise(F.col("word_text"))
    rows = rows.withColumns({"first_": F.coalesce(first, empty), "second_": F.coalesce(second, empty), "own_": own})
    text = F.when((F.size("engines_used") < 2) | (F.size("second_") == 0), F.col("own_")).otherwise(F.array_join(aligned(F.col("first_"), F.col("second_")), "\n"))
    return rows.select("rx_id", text.alias("text"), "avg_confidence", "engines_used", "primary_engine")
