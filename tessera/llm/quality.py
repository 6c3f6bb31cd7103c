"""Quality rules (op 2): a threshold table compiled into one projection of built-in functions.

Words are runs of characters other than ASCII white space. Everything is computed per row, so the plan has no
shuffle and no Python.

Defined results: a null or empty text has 0 words and fails the length rule; a ratio whose base is 0 is 0 and is
judged like any other; repeated rows are judged alike; extra columns are ignored, whatever their names; an empty
table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import fresh

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au aux dans de du en est et la le les par pas pour que qui sur un une "
    "al como con del el las lo los no por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: the metric must lie within [low, high]."""

    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("n_words", 50),
    Rule("mean_word_chars", 3.0, 10.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("bangs_per_word", None, 0.2),
    Rule("upper_words_share", None, 0.4),
    Rule("stop_words_share", 0.06, None),
    Rule("dup_lines_share", None, 0.5),
    Rule("ellipsis_lines_share", None, 0.3),
    Rule("bullet_lines_share", None, 0.9),
)


def _covered(words: str) -> str:
    """SQL for the number of words inside 3-word windows that occur twice or more.

    Windows are hashed to 64 bits. Sorted by (hash, place), repeated windows are neighbours; their places, sorted,
    each cover min(3, distance to the next) words.
    """
    windows = f"transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2]))"
    return f"""
    CASE WHEN size({words}) < 4 THEN 0L ELSE
      aggregate(array({windows}), 0L, (z, win) ->
        CASE WHEN size(array_distinct(win)) = size(win) THEN 0L ELSE
          aggregate(array(array_sort(transform(win, (h, i) -> struct(h AS h, i AS i)))), 0L, (y, s) ->
            aggregate(array(array_sort(transform(filter(transform(s, (x, j) -> struct(x.i AS i,
                coalesce(x.h = get(s, j - 1).h, false) OR coalesce(x.h = get(s, j + 1).h, false) AS twice)), x -> x.twice), x -> x.i))), 0L,
              (v, p) -> aggregate(transform(p, (q, k) -> least(3, coalesce(get(p, k + 1) - q, 3))), 0L, (a, b) -> a + b)))
        END)
    END"""


def measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "__m") -> DataFrame:
    """Adds the struct column ``name`` of all counts to the columns named in ``keep`` (all of ``docs`` by default)."""
    keep = docs.columns if keep is None else keep
    own = [F.col(f"`{c}`") for c in keep]
    whole, words, lines = (fresh(keep, x) for x in "twl")
    t = docs.select(*own, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(whole))
    t = t.select(
        *own,
        whole,
        F.expr(rf"regexp_extract_all({whole}, r'{WORD}', 0)").alias(words),
        F.expr(rf"filter(split({whole}, '\n'), l -> l rlike r'[^\x20\x09-\x0D]')").alias(lines),
    )
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    stops = f"size(filter({words}, w -> lower(rtrim('.,;:!?', w)) IN ({stop})))"
    m = {
        "n_words": f"size({words})",
        "word_chars": f"aggregate({words}, 0L, (a, w) -> a + length(w))",
        "n_symbols": f"regexp_count({whole}, r'{SYMBOL}')",
        "n_lines": f"size({lines})",
        "n_dup_lines": f"size({lines}) - size(array_distinct({lines}))",
        "n_repeat_words": _covered(words),
        "n_stop_words": stops,
        "n_bangs": f"regexp_count({whole}, '!')",
        "n_upper_words": rf"regexp_count({whole}, r'(?<![^\x20\x09-\x0D])[^a-z\x20\x09-\x0D]*\p{{Lu}}{{2}}[^a-z\x20\x09-\x0D]*(?![^\x20\x09-\x0D])')",
        "n_ellipsis_lines": f"size(filter({lines}, l -> l rlike r'(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))",
        "n_bullet_lines": f"size(filter({lines}, l -> l rlike r'^[\\x20\\x09-\\x0D]*[-*•]'))",
    }
    return t.select(*own, F.struct(*[F.expr(e).cast("long").alias(k) for k, e in m.items()]).alias(name))


def _share(m: str, top: str, base: str) -> Column:
    return F.when(F.col(f"{m}.{base}") > 0, F.col(f"{m}.{top}") / F.col(f"{m}.{base}")).otherwise(0.0)


def metrics(m: str = "__m") -> dict[str, Column]:
    """Ratios that rules refer to, over the column ``m``."""
    return {
        "n_words": F.col(f"{m}.n_words").cast("double"),
        "mean_word_chars": _share(m, "word_chars", "n_words"),
        "symbols_per_word": _share(m, "n_symbols", "n_words"),
        "bangs_per_word": _share(m, "n_bangs", "n_words"),
        "upper_words_share": _share(m, "n_upper_words", "n_words"),
        "stop_words_share": _share(m, "n_stop_words", "n_words"),
        "dup_lines_share": _share(m, "n_dup_lines", "n_lines"),
        "ellipsis_lines_share": _share(m, "n_ellipsis_lines", "n_lines"),
        "bullet_lines_share": _share(m, "n_bullet_lines", "n_lines"),
    }


def base_failed(m: str = "__m") -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def failures(rules: tuple[Rule, ...] = RULES, m: str = "__m") -> Column:
    """The names of the rules that a row breaks."""
    of = metrics(m)
    parts = []
    for r in rules:
        broken = F.lit(False)
        if r.low is not None:
            broken = broken | (of[r.metric] < r.low)
        if r.high is not None:
            broken = broken | (of[r.metric] > r.high)
        parts.append(F.when(broken, F.lit(r.metric)))
    return F.array_compact(F.array(*parts))


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``kept`` and the names of the broken rules."""
    m = measures(docs, text, [id_col])
    return m.select(
        F.col(id_col),
        *[F.col(f"__m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed().alias("base_failed"),
        (~base_failed() & (F.size(failures(rules)) == 0)).alias("kept"),
        F.array_join(failures(rules), ",").alias("broken_rules"),
    )


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with their columns unchanged.

    A filter would be pushed below the projections with a copy of every count in each rule; exploding an array of one
    or no element drops rows after each count has been made once.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    m, kept, one = (fresh(docs.columns, x) for x in ("m", "kept", "one"))
    judged = measures(docs, text, name=m).select(*own, (~base_failed(m) & (F.size(failures(rules, m)) == 0)).alias(kept))
    once = F.when(F.col(kept), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return judged.select(*own, F.explode(once).alias(one)).select(*own)
