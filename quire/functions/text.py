"""Text expressions: token estimates, sentences, packing, keywords, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English function words without weight in a search (fixed values).
STOPWORDS = """
a about above after again against all also am an and any are aren't as at be because been
before being below between both but by can can't cannot could couldn't did didn't do does
doesn't doing don't down during each few for from further get got had hadn't has hasn't have
haven't having he he'd he'll he's her here here's hers herself him himself his how how's i
i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my
myself no nor not of off on once only or other ought our ours ourselves out over own same
shan't she she'd she'll she's should shouldn't so some such than that that's the their
theirs them themselves then there there's these they they'd they'll they're they've this
those through to too under until up very was wasn't we we'd we'll we're we've were weren't
what what's when when's where where's which while who who's whom why why's will with won't
would wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split()

SENTENCE = r"(?U)(?<=[.!?])\s+"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def tokens(x: Column) -> Column:
    """A token is about four characters; one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4).cast("int"))


def _pack(items: Column, budget: int, oversize=None) -> Column:
    """Greedy packing of items, joined by a blank, into pieces of up to ``budget`` tokens.

    State: finished pieces, the open piece (null: none) and its tokens. ``oversize``
    turns one item that is too long by itself into pieces of its own.
    """
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("used"))

    def closed(s: Column) -> Column:
        return F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))

    def step(s: Column, item: Column) -> Column:
        t = tokens(item)
        fits = s["open"].isNotNull() & (s["used"] + t <= budget)
        added = F.when(fits, F.struct(s["done"].alias("done"), F.concat_ws(" ", s["open"], item).alias("open"), (s["used"] + t).alias("used"))).otherwise(
            F.struct(closed(s).alias("done"), item.alias("open"), t.alias("used"))
        )
        if oversize is None:
            return added
        alone = F.struct(F.concat(closed(s), oversize(item)).alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("used"))
        return F.when(t > budget, alone).otherwise(added)

    return F.aggregate(items, start, step, closed)


def split_words(x: Column, budget: int) -> Column:
    return _pack(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""), budget)


def split_text(x: Column, budget: int = 128) -> Column:
    """Pieces of up to ``budget`` tokens, cut between sentences, or words where a sentence is too long."""
    whole = strip(x)
    packed = _pack(F.split(whole, SENTENCE), budget, lambda s: split_words(s, budget))
    pieces = F.filter(F.transform(packed, strip), lambda p: p != "")
    return F.when(whole == "", F.expr("cast(array() as array<string>)")).when(tokens(whole) <= budget, F.array(whole)).otherwise(pieces)


def keywords(query: Column) -> Column:
    """Lower-cased words without punctuation, function words and single characters; repeats stay."""
    flat = F.regexp_replace(F.lower(query), r"[^\p{L}\p{N}_\s]", " ")
    stop = [w for w in STOPWORDS if "'" not in w]  # a word with an apostrophe has been split before
    return F.filter(F.split(flat, r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(stop))


def terms(x: Column) -> Column:
    return F.array_remove(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), "")


def term_count(x: Column) -> Column:
    """How many ``terms`` a text has, without making them."""
    return F.regexp_count(F.lower(x), F.lit(r"[\p{L}\p{N}]+"))


def truncate(x: Column, limit: Column | int) -> Column:
    """Cut at the last blank if that keeps more than half, with an ellipsis."""
    n = limit if isinstance(limit, Column) else F.lit(limit)
    head = F.substr(x, F.lit(1), n)
    at = F.length(head) - F.instr(F.reverse(head), " ")  # place of the last blank
    kept = F.when((F.instr(head, " ") > 0) & (at > n * 0.5), F.substr(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.regexp_replace(kept, r"(?U)\s+$", ""), F.lit("…")))


#: Stands for the blanks between sentences; no character of Unicode.
_JOINT = "\uffff"


def digest(x: Column, limit: int) -> Column:
    """Leading sentences within ``limit`` characters, the first always; one sentence is truncated."""

    def lead(whole: Column) -> Column:
        joined = F.concat(F.regexp_replace(whole, SENTENCE, _JOINT), F.lit(_JOINT))
        head = F.substring(joined, 1, limit)
        last = F.length(head) - F.instr(F.reverse(head), _JOINT)  # characters before the last joint
        first = F.substring_index(joined, _JOINT, 1)
        some = F.when(F.instr(head, _JOINT) == 0, first).otherwise(F.translate(F.substr(head, F.lit(1), last), _JOINT, " "))
        return F.when(F.length(whole) <= limit, whole).when(F.length(first) + 1 == F.length(joined), truncate(whole, limit)).otherwise(some)

    return F.get(F.transform(F.array(strip(x)), lead), F.lit(0))


def slug(x: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)


def preview(x: Column, limit: int = 180) -> Column:
    flat = strip(F.regexp_replace(x, r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def page_label(pages: Column) -> Column:
    return (
        F.when(F.coalesce(F.size(pages), F.lit(0)) < 1, F.lit(""))
        .when(F.size(pages) == 1, F.get(pages, F.lit(0)).cast("string"))
        .otherwise(F.concat_ws("-", F.get(pages, F.lit(0)).cast("string"), F.element_at(pages, -1).cast("string")))
    )
