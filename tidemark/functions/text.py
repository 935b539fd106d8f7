"""Headline and filing classifiers, symbol spelling and mixed time stamps, without Python rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The registered label patterns, in the order in which the first match wins.
EXCLUDED = (r"(?i)\bbundle offering\b", r"(?i)regained compliance")
LABELS = (
    ("REVERSE_SPLIT", r"(?i)reverse (stock |share )?split|\b1[- ]for[- ]\d{1,3}\b|share consolidation"),
    ("ATM", r"(?i)(?<!priced )at[- ]the[- ]market(?! under)|\bATM (offering|program|facility)"),
    ("OFFERING_PROPOSED", r"(?i)(proposed|intends? to offer|launch(es)?).{0,60}(offering|private placement)"),
    ("OFFERING_PRICED", r"(?i)(announces?|prices?|priced|pricing of|closes?|closing of).{0,80}(offering|registered direct|private placement|PIPE\b)"),
    ("WARRANT", r"(?i)warrant (inducement|exercise|amendment|repricing)|inducement (letter|agreement)"),
    ("DELIST_NOTICE", r"(?i)(nasdaq|nyse).{0,60}(deficiency|non-?compliance|delist|minimum bid)"),
)
# Filing forms and report items behind each label.
EVENT_FORMS = ("S-1", "S-1/A", "S-3", "424B4", "424B5", "EFFECT")
EVENT_ITEMS = ("1.01", "3.02")
SPLIT_ITEM = "5.03"
SHELF_FORM = "424B3"
PROXY_FORMS = ("DEF 14A", "PRE 14A", "DEFA14A")
DASHES = r"[‐‑‒–—−]"
ENTITIES = (("&#39;", "'"), ("&apos;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"))


def normalise_headline(text: Column) -> Column:
    """HTML entities unescaped, every dash folded to '-'."""
    out = F.coalesce(text, F.lit(""))
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.regexp_replace(out, DASHES, "-")


def headline_label(text: Column) -> Column:
    """First matching label, or NULL; the two exclusions win over every label."""
    t = normalise_headline(text)
    out = F.when(t.rlike(EXCLUDED[0]) | t.rlike(EXCLUDED[1]), F.lit(None).cast("string"))
    for label, pattern in LABELS:
        out = out.when(t.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(None).cast("string"))


def filing_labels(form: Column, items: Column) -> Column:
    """Zero, one or two labels for a filing; a current report can carry two at once."""
    parts = F.transform(F.split(F.coalesce(items, F.lit("")), ","), lambda x: F.trim(x))
    current = form.startswith("8-K")
    dilutes = form.isin(*EVENT_FORMS) | (current & F.arrays_overlap(parts, F.array(*[F.lit(i) for i in EVENT_ITEMS])))
    return F.array_compact(
        F.array(
            F.when(form == SHELF_FORM, "ACTIVE_SHELF_CANDIDATE"),
            F.when(form.isin(*PROXY_FORMS), "PROPOSED_RS_CANDIDATE"),
            F.when(dilutes, "TRIGGER_A"),
            F.when(current & F.array_contains(parts, SPLIT_ITEM), "TRIGGER_B"),
        )
    )


def edgar_stamp(raw: Column) -> Column:
    """The filing stamp is Eastern wall clock although it ends in Z."""
    wall = F.regexp_replace(raw, r"(\.\d+)?Z$", "")
    return F.to_utc_timestamp(F.try_to_timestamp(wall, F.lit("yyyy-MM-dd'T'HH:mm:ss")), "America/New_York")


def utc_stamp(raw: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(raw, r"(\.\d+)?Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def report_stamp(raw: Column) -> Column:
    """Broker report stamps of several formats; NULL when none fits."""
    shapes = ("yyyyMMdd;HHmmss", "yyyy-MM-dd;HH:mm:ss", "yyyyMMdd HHmmss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd, HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(s)) for s in shapes])


def chart_stamp(raw: Column) -> Column:
    """Epoch seconds or ISO text."""
    return F.coalesce(F.timestamp_seconds(F.when(raw.rlike(r"^\d{9,11}$"), raw).cast("bigint")), utc_stamp(raw))


def vendor_symbol(symbol: Column) -> Column:
    """One spelling for class shares: upper case, '-' and '/' become '.'."""
    return F.regexp_replace(F.upper(F.trim(symbol)), r"[-/ ]", ".")


def watchlist_symbols(text: Column) -> Column:
    """Symbols of a free-text watchlist."""
    words = F.split(F.upper(F.regexp_replace(text, r"[^A-Za-z.]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: w.rlike(r"^[A-Z]{1,5}(\.[A-Z])?$")))


def delay_seconds(mode: Column) -> Column:
    """900 out of delayed_streaming_900; 0 for streaming; NULL when unknown."""
    digits = F.regexp_extract(mode, r"^delayed_streaming_(\d+)$", 1)
    return F.when(digits != "", digits.cast("int")).when(mode == "streaming", 0)
