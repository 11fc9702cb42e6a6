"""One sentence for a signal, as Column expressions over the signal's own columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentences.
CLUSTER = "Cluster of %d captures across %d sources"
SHIFT = "Topic mix shifted at %s (KL=%.2f)"
BURST = "Symbol burst on %s: %d mentions, z-score %.1f."
ANOMALY = "Volume/sentiment anomaly: observed=%s, z-score %.1f."
SPILLOVER = "Spillover detected: %s => %s (score %.2f)."
WINDOW = "%d records in window across %d active cluster%s."
LIVE_BURST = "Symbol burst on %s (%d mentions, z=%.1f); %d volume / %d sentiment anomalies otherwise."
LIVE_ANOMALIES = "%d volume / %d sentiment anomalies firing; no symbol burst."
QUIET = "Anomaly flow is quiet — news mix is statistically normal."
TOP_EVENT = "Top event: %s%s, size %d, coherence %s."
SHIFTS = "%d regime shift%s detected over the window."


def _percent(x: Column) -> Column:
    return F.format_string("%.0f%%", x * 100)


def _listed(values: Column, n: int) -> Column:
    return F.array_join(F.slice(F.coalesce(values, F.array().cast("array<string>")), 1, n), ", ")


def _after(lead: str, text: Column) -> Column:
    """``lead`` and ``text``, or nothing for an empty text."""
    return F.when(text != "", F.concat(F.lit(lead), text)).otherwise("")


def cluster_text(size: Column, domains: Column, symbols: Column, reasons: Column) -> Column:
    return F.concat(F.format_string(CLUSTER, size, F.greatest(F.size(domains), F.lit(0))), _after(" — focused on ", _listed(symbols, 3)), _after(" via ", _listed(reasons, 2)), F.lit("."))


def shift_text(start: Column, kl: Column, assets: Column) -> Column:
    """``assets``: (key, share) of the bucket's labels, greatest first."""
    shown = F.transform(F.slice(assets, 1, 2), lambda x: F.concat(x["key"], F.lit(" "), _percent(x["share"])))
    return F.concat(F.format_string(SHIFT, start, kl), _after("; now dominated by ", F.array_join(shown, ", ")), F.lit("."))


def burst_text(symbol: Column, observed: Column, z: Column) -> Column:
    return F.format_string(BURST, symbol, observed, z)


def anomaly_text(observed: Column, z: Column) -> Column:
    return F.format_string(ANOMALY, observed.cast("string"), z)


def spillover_text(source: Column, target: Column, score: Column) -> Column:
    return F.format_string(SPILLOVER, source, target, score)


def live_text(context: Column) -> Column:
    """Two to four sentences from ``dashboard.live_context``'s columns, packed as one struct."""
    c = context
    plural = lambda n: F.when(n == 1, "").otherwise("s")
    burst, event = F.get(c["bursts"], 0), F.get(c["top_clusters"], 0)
    flow = (
        F.when(burst.isNotNull(), F.format_string(LIVE_BURST, burst["symbol"], burst["observed"], burst["z"], c["volume_anomalies"], c["sentiment_shocks"]))
        .when(c["volume_anomalies"] + c["sentiment_shocks"] > 0, F.format_string(LIVE_ANOMALIES, c["volume_anomalies"], c["sentiment_shocks"]))
        .otherwise(QUIET)
    )
    symbols = _listed(event["symbols"], 3)
    story = F.format_string(TOP_EVENT, F.when(symbols != "", symbols).otherwise("(no symbols)"), _after(" via ", _listed(event["reasons"], 2)), event["size"], _percent(event["coherence"]))
    return F.concat_ws(
        " ", F.format_string(WINDOW, c["records"], c["clusters"], plural(c["clusters"])), flow, F.when(event.isNotNull(), story),
        F.when(c["regime_shifts"] > 0, F.format_string(SHIFTS, c["regime_shifts"], plural(c["regime_shifts"]))),
    )
