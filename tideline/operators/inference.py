"""Around stored analyses: validation, beneficiaries, what is priced in, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.functions.documents import bind
from tideline.sources.records import ANALYSIS_SCHEMA, SYNTHESIS_SCHEMA


def _missing(keys: Column, required: tuple[str, ...], text: str) -> Column:
    absent = F.filter(F.array(*[F.lit(k) for k in required]), lambda k: ~F.array_contains(keys, k))
    return F.transform(absent, lambda k: F.concat(F.lit(text), F.lit("'"), k, F.lit("' 누락")))


def _one(cond: Column, message: Column) -> Column:
    return F.when(cond, F.array(message)).otherwise(F.array().cast("array<string>"))


def _said(v: Column) -> Column:
    return F.concat(F.lit("='"), F.coalesce(v, F.lit("None")), F.lit("'"))


def _elements(v: Column, key: str) -> Column:
    """Elements of an array inside a JSON value, whatever their types; none when it is no array."""
    return F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.expr("cast(array() as array<variant>)"))


def _field(v: Column, key: str) -> Column:
    """Text of a field; NULL for a missing one and for a value that is no object, where the path leads nowhere."""
    return F.try_variant_get(v, f"$.{key}", "string")


def _is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def _not_in(v: Column, allowed) -> Column:
    return ~F.coalesce(v.isin(*allowed), F.lit(False))


def _read_once(payload: Column, read, told) -> Column:
    """told(read(payload)) with both computed once a row, also where a filter takes the expression over."""
    return bind(payload, lambda p: bind(read(p), told))


def validate_analyses(stored: DataFrame) -> DataFrame:
    """stored(ticker, payload) -> rec, problems. An analysis is usable when it has no problem."""
    enums = {"cause_type": S.CAUSE_TYPES, "cause_scope": (S.SCOPE_COMPANY, S.SCOPE_INDUSTRY),
             "confidence": S.CONFIDENCE_LEVELS, "ripple_axis": S.RIPPLE_AXES}
    none = F.array().cast("array<string>")

    def of_beneficiary(b: Column) -> Column:
        return (F.when(F.coalesce(_field(b, "name"), F.lit("")) == "", F.lit("수혜 후보에 name이 없음"))
                .when(_not_in(_field(b, "impact"), (S.IMPACT_GAIN, S.IMPACT_LOSS)),
                      F.concat(F.lit("impact"), _said(_field(b, "impact")), F.lit(" 허용값 아님"))))

    def of_path(p: Column) -> Column:
        way = _one(_not_in(_field(p, "direction"), S.DIRECTIONS),
                   F.concat(F.lit("direction"), _said(_field(p, "direction")), F.lit(" 허용값 아님")))
        told = F.concat(way, F.array_compact(F.transform(_elements(p, "beneficiaries"), of_beneficiary)))
        return F.when(_is_object(p), told).otherwise(F.array(F.lit("ripple_paths 항목이 객체가 아님")))

    def told(x: Column) -> Column:
        keys, rec, paths = x["keys"], x["rec"], x["paths"]
        lists = [_missing(keys, S.CAUSE_TYPES_REQUIRED, "필수 항목 ")]
        for k, allowed in enums.items():
            lists.append(_one(F.array_contains(keys, k) & _not_in(rec[k], allowed),
                              F.concat(F.lit(k), _said(rec[k]), F.lit("는 허용값이 아님"))))
        lists.append(F.coalesce(F.flatten(F.transform(paths, of_path)), none))
        lists.append(_one((rec["cause_scope"] == S.SCOPE_COMPANY) & (F.size(paths) > 0),
                          F.lit("회사고유인데 파급 경로가 있음")))
        return F.when(keys.isNull(), F.array(F.lit("객체가 아님"))).otherwise(F.concat(*lists))

    read = lambda p: F.struct(F.json_object_keys(p).alias("keys"), F.from_json(p, ANALYSIS_SCHEMA).alias("rec"),
                              _elements(F.try_parse_json(p), "ripple_paths").alias("paths"))
    return stored.select("ticker", F.from_json("payload", ANALYSIS_SCHEMA).alias("rec"),
                         _read_once(F.col("payload"), read, told).alias("problems"))


def validate_synthesis(stored: DataFrame) -> DataFrame:
    """stored(run, payload) -> rec, problems for the summary document of each run."""
    def of_idea(i: Column) -> Column:
        axis = _one(_not_in(_field(i, "axis"), S.IDEA_AXES), F.concat(F.lit("axis"), _said(_field(i, "axis")), F.lit(" 허용값 아님")))
        bad = F.filter(_elements(i, "beneficiaries"), lambda b: _not_in(_field(b, "priced_in"), S.PRICED_IN))
        told = F.transform(bad, lambda b: F.concat(F.lit("priced_in"), _said(_field(b, "priced_in")), F.lit(" 허용값 아님")))
        return F.concat(axis, told)

    def told(x: Column) -> Column:
        lists = F.concat(_missing(x["keys"], S.SYNTHESIS_REQUIRED, ""), F.coalesce(
            F.flatten(F.transform(x["ideas"], of_idea)), F.array().cast("array<string>")))
        return F.when(x["keys"].isNull(), F.array(F.lit("객체가 아님"))).otherwise(lists)

    read = lambda p: F.struct(F.json_object_keys(p).alias("keys"), _elements(F.try_parse_json(p), "ideas").alias("ideas"))
    return stored.select("run", F.from_json("payload", SYNTHESIS_SCHEMA).alias("rec"),
                         _read_once(F.col("payload"), read, told).alias("problems"))


def usable(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("problems") == 0).drop("problems")


def problem_rows(validated: DataFrame, key: str) -> DataFrame:
    return validated.select(key, F.posexplode("problems").alias("pos", "problem"))


def industry_wide(analyses: DataFrame) -> DataFrame:
    """Only causes that concern a whole industry feed the synthesis."""
    return analyses.where(F.col("rec.cause_scope") == S.SCOPE_INDUSTRY)


def analysis_beneficiaries(analyses: DataFrame) -> DataFrame:
    """(ticker_of, axis NULL, name, impact) from every path of every analysis."""
    paths = analyses.select(F.col("ticker").alias("origin"), F.explode("rec.ripple_paths").alias("p"))
    b = paths.select("origin", F.explode("p.beneficiaries").alias("b"))
    return b.select(F.lit("analysis").alias("shape"), "origin", "b.name", "b.impact")


def synthesis_beneficiaries(runs: DataFrame, key: str = "run", rec: str = "rec") -> DataFrame:
    ideas = runs.select(F.col(key).cast("string").alias("origin"), F.explode(f"{rec}.ideas").alias("i"))
    b = ideas.select("origin", F.explode("i.beneficiaries").alias("b"))
    return b.select(F.lit("synthesis").alias("shape"), "origin", "b.name", "b.impact")


def annotate_priced_in(named: DataFrame, resolved: DataFrame, returns: DataFrame, best: DataFrame) -> DataFrame:
    """Beneficiaries with ticker, recent returns and the largest unreacted gap."""
    j = named.join(resolved.select(F.col("company").alias("name"), "ticker"), "name", "left")
    # names without a ticker skip these joins: their NULL keys would meet in one task
    known = j.where(F.col("ticker").isNotNull()).join(
        returns.select("ticker", "ret5", "ret20"), "ticker", "left").join(
        best.select("ticker", "gap", F.col("grp").alias("gap_group"), "beta"), "ticker", "left")
    return known.unionByName(j.where(F.col("ticker").isNull()), allowMissingColumns=True).select(*known.columns)


def match_stats(annotated: DataFrame) -> DataFrame:
    return annotated.groupBy("shape").agg(F.count("ticker").alias("matched"), F.count("*").alias("total"))


def unmatched_names(annotated: DataFrame) -> DataFrame:
    return annotated.where(F.col("ticker").isNull()).select("shape", "name").distinct()


def with_provenance(annotated: DataFrame, reach: DataFrame) -> DataFrame:
    """graph_backed / via for beneficiaries with a ticker; rows without one are left out."""
    j = annotated.where(F.coalesce("ticker", F.lit("")) != "").join(
        reach.select("ticker", "via"), "ticker", "left")
    return j.withColumn("graph_backed", F.col("via").isNotNull())


def provenance_stats(marked: DataFrame) -> DataFrame:
    return marked.groupBy("shape").agg(F.count_if("graph_backed").alias("graph_backed"),
                                       F.count("*").alias("total"))


def _looked_up(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``; rows without one skip it, so NULL keys never meet in one task."""
    met = left.where(F.col(key).isNotNull()).join(right, key, "left")
    return met.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)


def annotated_cases(runs: DataFrame, resolved: DataFrame, best: DataFrame, reach: DataFrame, as_of: str) -> DataFrame:
    """(base_date, run, synthesis): usable summaries as the case documents that are scored later.

    ``runs(run, rec)`` names a document once; ``resolved(company, ticker)``, ``best(ticker, gap)`` and
    ``reach(ticker, via)`` have one row per key. A resolved name sets ticker and gap, a ticker sets
    graph_backed and via; what nobody knows better stays as stored. Order and ideas without
    beneficiaries are kept: only beneficiaries travel to their keys and come back to their document.
    """
    one = (runs.select("run", F.posexplode("rec.ideas").alias("idea", "i"))
           .select("run", "idea", F.posexplode("i.beneficiaries").alias("pos", "b")).withColumn("name", F.col("b.name")))
    named = _looked_up(one, resolved.select(F.col("company").alias("name"), F.col("ticker").alias("found")), "name")
    gapped = _looked_up(named, best.select(F.col("ticker").alias("found"), F.col("gap").alias("new_gap")), "found")
    backed = _looked_up(gapped.withColumn("ticker", F.nullif(F.coalesce("found", "b.ticker"), F.lit(""))),
                        reach.select("ticker", F.col("via").alias("new_via")), "ticker")
    b = (F.col("b").withField("ticker", F.coalesce("found", "b.ticker")).withField("gap", F.coalesce("new_gap", "b.gap"))
         .withField("via", F.coalesce("new_via", "b.via"))
         .withField("graph_backed", F.when(F.col("ticker").isNotNull(), F.col("new_via").isNotNull()).otherwise(F.col("b.graph_backed"))))
    back = backed.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("idea", "pos", b.alias("b")))).alias("told"))
    ideas = F.transform("rec.ideas", lambda i, k: i.withField(
        "beneficiaries", F.transform(F.filter("told", lambda x: x["idea"] == k), lambda x: x["b"])))
    synthesis = F.col("rec").withField("ideas", F.when(F.col("told").isNull(), F.col("rec.ideas")).otherwise(ideas))
    return runs.join(back, "run", "left").select(
        F.lit(as_of).cast("date").alias("base_date"), "run", synthesis.alias("synthesis"))
