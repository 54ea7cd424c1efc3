"""Distress vetoes from filings: (signals, filings) -> signals + blocked, reason."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .asof import asof_backward

# Filing items that block a signal, with their reason.
DISTRESS_ITEMS = {
    "1.03": "Bankruptcy or Receivership",
    "4.01": "Change in Registrant's Certifying Accountant (auditor red flag)",
    "4.02": "Non-Reliance on Previously Issued Financial Statements (restatement)",
    "1.05": "Material Cybersecurity Incident",
}
GOING_CONCERN = ("substantial doubt", "going concern")
LOOKBACK_DAYS = 90


def first_distress_item(items: Column) -> Column:
    return F.filter(items, lambda i: i.isin(*DISTRESS_ITEMS)).getItem(0)


def distress_events(filings: DataFrame) -> DataFrame:
    """8-K filings that carry a distress item, with the first such item."""
    hits = F.filter(F.col("items"), lambda i: i.isin(*DISTRESS_ITEMS))
    return filings.where((F.col("form") == "8-K") & F.col("filing_date").isNotNull() & (F.size(hits) > 0)).withColumn(
        "item", hits[0])


def daily_distress(filings: DataFrame) -> DataFrame:
    """At most one distress event per (ticker, day): the lowest accession wins."""
    return distress_events(filings).groupBy("ticker", "filing_date").agg(F.min_by("item", "accession").alias("item"))


def item_label(item: Column) -> Column:
    expr = None
    for code, text in DISTRESS_ITEMS.items():
        expr = F.when(item == code, text) if expr is None else expr.when(item == code, text)
    return expr


def distress_reason(item: Column, filed: Column) -> Column:
    return F.concat(F.lit("8-K Item "), item, F.lit(" filed "), F.date_format(filed, "yyyy-MM-dd"), F.lit(": "),
                    item_label(item))


def concern_reason(form: Column, filed: Column) -> Column:
    return F.concat(form, F.lit(" filed "), F.date_format(filed, "yyyy-MM-dd"),
                    F.lit(": going-concern doubt (substantial doubt / going concern)"))


def mentions_all(text: Column, phrases: Sequence[str] = GOING_CONCERN) -> Column:
    """TRUE when every phrase occurs in the text, whatever its case."""
    low = F.lower(text)
    expr = F.lit(True)
    for phrase in phrases:
        expr = expr & F.contains(low, F.lit(phrase.lower()))
    return F.coalesce(expr, F.lit(False))


def flag_documents(documents: DataFrame, phrases: Sequence[str] = GOING_CONCERN) -> DataFrame:
    """documents(doc_id, text) to (doc_id, concern): a narrow scan, the text never shuffles."""
    return documents.select("doc_id", mentions_all(F.col("text"), phrases).alias("concern"))


def latest_report(signals: DataFrame, filings: DataFrame) -> DataFrame:
    """signals + form, filed and document of the newest annual or quarterly report at their date."""
    reports = (filings.where(F.col("form").isin("10-K", "10-Q")).groupBy("ticker", "filing_date")
               .agg(F.min_by(F.struct("form", "doc_id"), "accession").alias("_r"))
               .select("ticker", F.col("filing_date").alias("report_date"), F.col("_r.form").alias("report_form"),
                       F.col("_r.doc_id").alias("report_doc")))
    return asof_backward(signals, reports, ["ticker"], "date", "report_date",
                         ["report_date", "report_form", "report_doc"])


def going_concern(signals: DataFrame, filings: DataFrame, flags: DataFrame) -> DataFrame:
    """signals + `concern` of their newest report only; flags(doc_id, concern)."""
    flagged = flags.where("concern").select(F.col("doc_id").alias("report_doc"), F.lit(True).alias("concern"))
    return latest_report(signals, filings).join(flagged, "report_doc", "left").withColumn(
        "concern", F.coalesce("concern", F.lit(False)))


def veto(signals: DataFrame, filings: DataFrame, flags: DataFrame | None = None,
         lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """signals(ticker, date, ...) + blocked, reason.

    The newest distress filing at or before the date decides, so one as-of join
    replaces a join with every filing of the window. No filing record at all
    means not blocked, with the reason "unverifiable".
    """
    events = daily_distress(filings).select("ticker", F.col("filing_date").alias("_filed"), F.col("item").alias("_item"))
    found = asof_backward(signals, events, ["ticker"], "date", "_filed", ["_filed", "_item"])
    recent = F.col("_filed") >= F.date_sub("date", lookback)
    found = found.withColumn("_distress", F.when(recent, distress_reason(F.col("_item"), F.col("_filed"))))
    if flags is not None:
        found = going_concern(found, filings, flags).withColumn(
            "_concern", F.when(F.col("concern"), concern_reason(F.col("report_form"), F.col("report_date"))))
        found = found.drop("concern", "report_doc", "report_form", "report_date")
    else:
        found = found.withColumn("_concern", F.lit(None).cast("string"))
    known = filings.select("ticker").distinct().withColumn("_known", F.lit(True))
    return _with_verdict(found.join(known, "ticker", "left")).drop("_filed", "_item")


def _with_verdict(found: DataFrame) -> DataFrame:
    """blocked and reason from the two findings and from whether the ticker has any filing record."""
    return found.withColumns({
        "blocked": F.col("_distress").isNotNull() | F.col("_concern").isNotNull(),
        "reason": F.when(F.col("_known").isNull(), F.concat(
            F.lit("unverifiable: no filing record for "), F.col("ticker"))).otherwise(
                F.coalesce("_distress", "_concern", F.lit("")))}).drop("_distress", "_concern", "_known")


def filing_state(filings: DataFrame, day: Column) -> DataFrame:
    """Per ticker with any filing record: the newest distress filing and the newest annual or quarterly report
    up to one day. One scan and one partial aggregate; of several filings on one day the lowest accession counts."""
    ago = F.datediff(day, "filing_date")
    newest = lambda cond, **cols: F.min(F.when(cond & (ago >= 0), F.struct(
        ago.alias("ago"), F.col("accession").isNull().alias("unnamed"), "accession", F.col("filing_date").alias("filed"), *[c.alias(n) for n, c in cols.items()])))
    hits = F.filter(F.col("items"), lambda i: i.isin(*DISTRESS_ITEMS))
    return filings.groupBy("ticker").agg(
        F.lit(True).alias("_known"), newest((F.col("form") == "8-K") & (F.size(hits) > 0), item=F.get(hits, F.lit(0))).alias("_d"),
        newest(F.col("form").isin("10-K", "10-Q"), form=F.col("form"), doc=F.col("doc_id")).alias("_r"))


def veto_on(signals: DataFrame, filings: DataFrame, day: Column, flags: DataFrame | None = None, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """`veto` of signals(ticker, ...) that all stand on one day: last filings by aggregation, no time line and no window."""
    recent = F.col("_d.ago") <= lookback
    found = signals.join(filing_state(filings, day), "ticker", "left").withColumn(
        "_distress", F.when(recent, distress_reason(F.col("_d.item"), F.col("_d.filed"))))
    concern = F.lit(None).cast("string")
    if flags is not None:
        flagged = flags.where("concern").select(F.col("doc_id").alias("_doc"), F.lit(True).alias("_flag"))
        found = found.withColumn("_doc", F.col("_r.doc")).join(flagged, "_doc", "left").drop("_doc")
        concern = F.when(F.col("_flag"), concern_reason(F.col("_r.form"), F.col("_r.filed")))
    found = found.withColumn("_concern", concern)
    return _with_verdict(found).drop("_d", "_r", "_flag")


def veto_buys(rows: DataFrame, filings: DataFrame, rule=veto, **options) -> DataFrame:
    """Turn blocked BUY rows into VETO; others keep their signal. `rule` is any (signals, filings) ->
    signals + blocked, reason transform; it runs once over all rows, so what they derive from does too."""
    hit = (F.col("signal") == "BUY") & F.col("blocked")
    return rule(rows, filings, **options).withColumns({
        "veto_reason": F.when(hit, F.col("reason")), "signal": F.when(hit, "VETO").otherwise(F.col("signal"))}).drop("blocked", "reason")


def distress_census(filings: DataFrame, start: Column, end: Column) -> DataFrame:
    """Distress events and distinct tickers in a window, per item."""
    window = distress_events(filings).where(F.col("filing_date").between(start, end))
    return window.groupBy("item").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("ticker").alias("tickers"))
