"""First text containing each label, by an inverted index of q-grams.

`text LIKE '%label%'` over two tables is a nested loop. Here every text gives one posting for each of
its characters, the q-gram that begins there with its position, so the index grows with the texts' length
and not with the number or the lengths of labels. Of each label's own q-grams the one that occurs
least in the texts becomes its anchor: only its postings are candidates, and the text around the place
decides. A label with a q-gram that no text has is out at once.

Labels of q characters and less need no candidates: the smallest code of each short gram, which is
combined map-side, is their answer. Labels with wildcards are anchored on their longest literal
piece, and LIKE decides. Labels of wildcards only match any text long enough, which a running minimum
over the distinct lengths answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pantryline.functions.text import ascii_fold, like_escape
from pantryline.operators.skew import hot_groups_of, join_parent
from pantryline.session import staged

Q = 3


def _grams(text: Column, n: Column) -> Column:
    """(gram, at) for every place of `text` from which n characters follow, places counted from 1."""
    places = F.sequence(F.lit(1), F.char_length(text) - n + 1)
    return F.transform(places, lambda at: F.struct(F.substr(text, at, n).alias("gram"), at.alias("at")))


def _postings(texts: DataFrame, lengths: DataFrame) -> DataFrame:
    """(code, gram, at): a row for every place of every text, for each gram length in `lengths`.

    Lengths are 1 to Q, so `lengths` reduces to Q numbers at most. The text itself isn't repeated;
    `code` finds it again.
    """
    wanted = lengths.agg(F.collect_set("n").alias("ns")).scalar()
    sized = texts.select("text", "code", F.explode(wanted).alias("n")).filter(F.col("n") <= F.char_length("text"))
    return sized.select("code", F.explode(_grams(F.col("text"), F.col("n"))).alias("place")).select("code", "place.*")


def _anchors(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Keys with their rarest gram, as `gram`, its place `offset` in the piece, and its number of postings, `n_postings`.

    Keys with a gram that is in no text are gone.
    """
    gram_length = F.least(F.col("n"), F.lit(Q))
    own = keys.select("folded", F.explode(_grams(F.col("piece"), gram_length)).alias("place"))
    rarest = (
        own.select("folded", "place.*")
        .join(index, "gram", "left")
        .groupBy("folded")
        .agg(
            F.min(F.struct("n_postings", "at", "gram")).alias("anchor"),
            F.bool_and(F.col("n_postings").isNotNull()).alias("possible"),
        )
        .filter("possible")
        .select("folded", "anchor.gram", F.col("anchor.at").alias("offset"), "anchor.n_postings")
    )
    return keys.join(rarest, "folded")


def first_containing(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """(label, code) for every distinct label found in a text, ignoring ASCII case.

    `labels` has `label`; `texts` has `code` and `text`. Of all matching texts the
    smallest code wins. `%` and `_` in a label are wildcards; an empty label matches
    every non-null text. Runs jobs when called: distinct texts and anchored labels are written to the
    shared folder, as each is read several times.
    """
    wanted = labels.filter(F.col("label").isNotNull()).select(
        F.col("label"), ascii_fold(F.col("label")).alias("folded")
    ).distinct()
    folded = staged(
        texts.filter(F.col("text").isNotNull())
        .groupBy(ascii_fold(F.col("text")).alias("text"))
        .agg(F.min("code").alias("code")),
        "texts",
    )
    keys = wanted.select("folded").distinct()
    # Longest run without wildcards; for a plain label that is the label itself.
    pieces = F.split("folded", "[%_]+")
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.char_length(p).alias("n"), p.alias("piece"))))
    keys = keys.select("folded", longest["piece"].alias("piece"), longest["n"].alias("n"), F.rlike("folded", F.lit("[%_]")).alias("wild"))
    literal = keys.filter(F.col("n") > 0)
    bare = keys.filter(F.col("n") == 0)

    lengths = literal.select(F.least(F.col("n"), F.lit(Q)).alias("n")).distinct()
    postings = _postings(folded, lengths)
    index = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n_postings"), F.min("code").alias("code"))
    anchored = staged(_anchors(literal, index.drop("code")), "anchors")
    short = ~F.col("wild") & (F.col("n") <= Q)
    short_hits = anchored.filter(short).join(index.select("gram", "code"), "gram").select("folded", "code")

    # A posting meets the labels anchored on its gram; those of a gram that many texts have are spread.
    held = anchored.filter(~short).select("folded", "gram", "offset", "n", "wild")
    hot = hot_groups_of(anchored.filter(~short).select("gram", "n_postings").distinct(), "gram", "n_postings")
    begin = F.col("at") - F.col("offset") + 1
    candidates = (
        join_parent(postings, held, "gram", "inner", hot=hot)
        .select("code", "folded", "n", "wild", begin.alias("begin"))
        .filter(F.col("wild") | (F.col("begin") > 0))
    )
    pattern = F.concat(F.lit("%"), like_escape(F.col("folded")), F.lit("%"))
    there = F.when(F.col("wild"), F.like(F.col("text"), pattern)).otherwise(
        F.substr("text", "begin", "n") == F.col("folded")
    )
    long_hits = candidates.join(folded, "code").filter(there).groupBy("folded").agg(F.min("code").alias("code"))

    # Smallest code among texts of at least k characters: from the longest text down, a length before
    # an equally long label. As many rows as there are distinct lengths of texts and labels.
    length = F.char_length(F.replace("folded", F.lit("%"), F.lit("")))
    by_length = folded.groupBy(F.char_length("text").alias("k")).agg(F.min("code").alias("code"))
    asked = bare.select(length.alias("k"), F.lit(None).cast(folded.schema["code"].dataType).alias("code")).distinct()
    downwards = Window.orderBy(F.desc("k"), "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_least = (
        by_length.withColumn("asked", F.lit(0))
        .unionByName(asked.withColumn("asked", F.lit(1)))
        .withColumn("code", F.min("code").over(downwards))
        .filter((F.col("asked") == 1) & F.col("code").isNotNull())
        .select("k", "code")
    )
    bare_hits = bare.select("folded", length.alias("k")).join(at_least, "k").select("folded", "code")
    hits = short_hits.unionByName(long_hits).unionByName(bare_hits)
    return wanted.join(hits, "folded").select("label", "code")
