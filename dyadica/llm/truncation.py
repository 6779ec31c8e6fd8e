"""Texts cut off by field limits or broken transfers.

The corpus itself says what its words are and how its sentences end. All words go into a
trie, held as a table of prefixes with the number of words seen below each. The same is done with sequences of words: up to three words are a node, with how often
they go on and how often a sentence ends there, over different texts. A text that ends like a sentence is whole. Of the others,
what was put after a possible break (page marks, ellipses, the beginning of a tag) is taken off, and
the text is truncated if

* its final token is no known word but a proper prefix of known ones (``prefix``),
* it has the length at which its source cuts: one at which that source's texts pile up (``limit``),
* its final words are a node of the trie of words at which sentences never, or hardly ever, end (``unfinished``),
* or it ends inside a bracket, a quotation, a tag, an entity or a character, or on a comma (``open``).

A text that ends on a dash was interrupted, not truncated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dyadica.operators.skew import lookup_join
from dyadica.session import cut, stored


@dataclass(frozen=True)
class CutRules:
    """known: times a word must occur within texts to be one. below: how many times more often its
    continuations must occur than a token itself for it to count as unknown. support: times that words
    must occur for their share of sentence ends to be judged. ends: the share up to which they never
    end a sentence; of the texts that stop after words without a full stop, as many as spared are taken for truncated,
    if the text in question has full stops at all (titles and captions have none). near: lengths on either side that a limit is held against. common: how many times the share it has in other sources a limit's must be."""

    known: int = 3
    below: int = 50
    support: int = 8
    spared: int = 2
    ends: float = 0.02
    common: float = 4.0
    near: int = 30


#: What a scan or a feed puts after a text: page marks on a line of their own (a fixed pattern of such a line), or nothing.
_PAGE = r"^\s*(-\s?[0-9]+\s?-\s*|\[p\. ?[0-9]+\]\s*)?$"
#: Marks that stand for the missing rest (fixed values).
_MARK = r"\s*(\[\s?(\.\.\.|…)\s?\]|\((\.\.\.|…)\)|\.\.\.|…)$"
#: The beginning of a tag or an entity that isn't closed.
_BROKEN = r"\s*(<[/!]?\p{L}[^<>]{0,80}|<|&(#\d{0,6}|#x[0-9A-Fa-f]{0,6}|a|am|amp|ap|apo|apos|g|gt|l|lt|n|nb|nbs|nbsp|q|qu|quo|quot|s|sh|shy)?)$"
_BYTES = "[\\ufffd]+$"
#: Ends of a sentence, with what may close after it.
_END = r"[.!?。؟][\s\"'”’»›“)\]\}*]*$"
_DASH = r"(^|\s)(–|—|--?)$"
#: Blank and invisible characters that may trail a text.
_BLANK = " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200E))) + "\u2028\u2029\u202f\u205f\u2060\u3000\ufeff\xad"
#: The characters that page marks are made of, and the most that the other marks can have: how far from the end they are looked for.
_PAGED, _MOST = _BLANK + "0123456789-[]p.", 100
#: Tokens are runs of these; everything else parts them.
_IN, _OUT = r"[\p{L}\p{M}\p{N}]", r"[^\p{L}\p{M}\p{N}]"
#: Signs put between tokens for the end of a sentence and for a colon.
_STOP, _COLON = "\x01", "\x02"


#: Bits of the filter of the words that are asked for, in words of 64.
BITS = 1 << 22

TRIPLE, SUMS = ["prev2", "prev", "tok"], ["n", "ends", "last", "inner", "rows_n", "rows_ends", "rows_last", "rows_inner"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _strip(c: Column) -> Column:
    return F.rtrim(c, F.lit(_BLANK))


def _tokens(text: Column) -> Column:
    """The tokens of a text in lower case, every number alike, with signs where a sentence ends or a colon stands.

    All of it is done by passes over the whole text; nothing is matched token by token.
    """
    t = F.regexp_replace(F.lower(F.translate(text, "\x01\x02", "  ")), r"\p{N}+(?:[.,:]\p{N}+)*+", "0")
    t = F.regexp_replace(t, rf"(?U)(?!{_IN})(?<={_IN}{_IN})[\"'”’»)\]]*\s*(?:[.!?…]|[–—](?:\s|$)|-\s|(?<=\p{{L}})\)){_OUT}*", f" {_STOP} ")
    t = F.regexp_replace(t, rf"(?U)(?!{_IN})(?<={_IN})[^\p{{L}}\p{{M}}\p{{N}}{_STOP}]*:\s*(?={_IN})", f" {_COLON} ")
    t = F.regexp_replace(t, rf"[^\p{{L}}\p{{M}}\p{{N}}{_STOP}{_COLON}]+", " ")
    return F.filter(F.split(t, " "), lambda x: x != "")


def _contexts(a: str) -> Column:
    """Each token with the two before it and the sign or token after it: arrays side by side, without a function per token."""
    before = F.transform(a, lambda x: F.when(x == _STOP, "").when(x == _COLON, ":").otherwise(x))
    none = F.array(F.lit(""))
    n = F.size(a)
    two = F.slice(F.concat(none, none, before), F.lit(1), n)
    one = F.slice(F.concat(none, before), F.lit(1), n)
    after = F.slice(a, F.lit(2), n)
    return F.arrays_zip(two.alias("prev2"), one.alias("prev"), F.col(a).alias("tok"), after.alias("next"))


def tails(docs: DataFrame) -> DataFrame:
    """Each text with content as ``t``, what is left of it without marks put after its end, and which marks were found.

    Whole texts are looked at: what can be part of a mark is told by its characters, or by the mark's greatest length.
    """

    def paged(t: Column) -> Column:  # page marks are lines within the run of their characters at the end, whose first line begins before it
        return _let(F.length(F.rtrim(t, F.lit(_PAGED))), lambda n: _let(F.split(F.substr(t, n + 1), r"[\r\n]"), lambda lines: unpaged(t, n, lines)))

    def unpaged(t: Column, n: Column, lines: Column) -> Column:
        other = F.transform(F.reverse(lines), lambda x, i: ~x.rlike("(?U)" + _PAGE) | ((i == F.size(lines) - 1) & (n > 0)))
        kept = _let(F.array_position(other, True), lambda k: F.when(k == 0, F.array().cast("array<string>")).otherwise(F.slice(lines, F.lit(1), F.size(lines) - k.cast("int") + 1)))
        return _strip(F.concat(F.left(t, n), F.array_join(kept, "\n")))

    def ending(z: Column, pattern: str) -> Column:
        """``z`` without the mark at its end, and whether there is one."""
        end = F.right(z, F.lit(_MOST))
        head = F.left(z, F.greatest(F.length(z) - _MOST, F.lit(0)))
        return F.struct(_strip(F.concat(head, F.regexp_replace(end, "(?U)" + pattern, ""))).alias("t"), end.rlike("(?U)" + pattern).alias("hit"))

    def cleaned(t: Column) -> Column:
        return _let(_let(t, paged), lambda z: _let(F.rtrim(z, F.lit("\ufffd")), lambda y: _let(ending(y, _BROKEN), lambda b: unbroken(z, y, b))))

    def unbroken(z: Column, y: Column, b: Column) -> Column:
        broken = b["hit"] | (F.length(y) < F.length(z))
        return _let(broken, lambda x: _let(ending(F.when(x, b["t"]).otherwise(z), _MARK), lambda m: F.struct(F.when(m["hit"], m["t"]).otherwise(F.when(x, b["t"]).otherwise(z)).alias("t"), x.alias("broken"), m["hit"].alias("marked"))))

    # a generator evaluates the chain once a row, where a projection would be copied into every filter on it
    d = docs.where("text IS NOT NULL").select("doc_id", "source", "text", F.inline(F.array(_let(_strip(F.col("text")), cleaned))))
    return d.where("t != ''")


def limits(docs: DataFrame, rules: CutRules = CutRules()) -> DataFrame:
    """source, unit (``chars`` or ``bytes``), size: the lengths at which a source's texts pile up.

    A length is a limit if so many different texts have it as chance does not allow from the lengths around it, and not just as many, in proportion, as
    in other sources (lengths of formulas that all use), unless next to no text of the source is longer.
    """
    sizes = F.array(F.struct(F.lit("chars").alias("unit"), F.length("text").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").alias("size")))
    rows = docs.where("text IS NOT NULL AND text != ''").select("source", F.xxhash64("text").alias("h"), F.inline(sizes))
    counts = rows.distinct().groupBy("source", "unit", "size").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("source", "unit")
    around = of.orderBy("size").rangeBetween(-rules.near, rules.near)
    counts = counts.withColumn("rate", (F.sum("n").over(around) - F.col("n")) / (2.0 * rules.near)).withColumn("share", F.col("n") / F.sum("n").over(of))
    counts = counts.withColumn("longer", F.coalesce(F.sum("n").over(of.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.sum("n").over(of))
    sources = counts.groupBy("unit").agg(F.countDistinct(F.coalesce("source", F.lit("\x00"))).alias("sources"))
    # a mean of roots, which a few sources with the same limit don't move much
    usual = counts.groupBy("unit", "size").agg(F.sum(F.sqrt("share")).alias("roots"))
    counts = counts.join(usual, ["unit", "size"]).join(sources, "unit").withColumn("elsewhere", F.pow((F.col("roots") - F.sqrt("share")) / F.greatest(F.col("sources") - 1, F.lit(1)), F.lit(2)))
    high = (F.col("n") >= 5) & (F.col("n") > 4 * F.col("rate") + 6 * F.sqrt("rate") + 3)
    piled = counts.where(high & ((F.col("share") > rules.common * F.col("elsewhere")) | (F.col("longer") < 0.01)))
    # a limit in one unit makes smaller piles in the other: a pile stands if most of its texts are in no larger one
    hits = rows.distinct().alias("a").join(piled.select("source", "unit", "size", "n").alias("b"), F.expr("a.source <=> b.source AND a.unit = b.unit AND a.size = b.size")).select("a.*", "n")
    own = hits.withColumn("own", (F.row_number().over(Window.partitionBy("source", "h").orderBy(F.desc("n"), F.desc("unit"))) == 1).cast("int"))
    return own.groupBy("source", "unit", "size").agg(F.max("n").alias("n"), F.avg("own").alias("own")).where("own >= 0.5").drop("own")


def _never(rules: CutRules, spared: int, by: str = "") -> Column:
    """Whether words never end a sentence, judged by the widest context seen often enough; ``spared`` of the texts that
    stop there are taken for truncated ones. ``by``: ``rows_`` to count rows, not different texts."""
    of = lambda x, k: F.col(f"{by}{x}{k}")
    seldom = lambda k: of("ends", k) + F.greatest(of("last", k) - spared, F.lit(0)) <= rules.ends * of("n", k)
    alone = (of("n", 1) >= rules.support) & seldom(1)
    narrow = F.when(of("n", 2) >= rules.support, seldom(2)).when(of("inner", 2) >= 1, alone).when((of("n", 2) < 3) & ~F.col("prev").isin("", ":"), alone).otherwise(False)
    return F.when(of("n", 3) >= rules.support, seldom(3)).otherwise(narrow)


def _bits(keys: DataFrame, *key: str) -> Column:
    """A literal with a bit for each hash of the keys: a filter of bounded size, which may let others through."""
    h = F.pmod(F.xxhash64(*key), F.lit(BITS))
    of = keys.select(h.alias("h")).groupBy((F.col("h") / 64).cast("int").alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("h") % 64).cast("int"))).alias("w"))
    words = [0] * (BITS // 64)
    for r in of.collect():  # BITS / 64 rows at most
        words[r["i"]] = r["w"]
    return F.from_json(F.lit(str(words).replace(" ", "")), "array<bigint>")


def _let_through(bits: Column, *key: Column) -> Column:
    h = F.pmod(F.xxhash64(*key), F.lit(BITS))
    return F.call_function("shiftright", F.get(bits, (h / 64).cast("int")), (h % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def triples(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """prev2, prev, tok, n, ends, last, inner: neighbouring words of the corpus, how often seen, how often a sentence ends
    after them, how often a text stops there without a sentence's end, and how often they stand within a text. What comes before is empty at the start of a sentence, a colon after one.

    Different texts count once, as a cut text that is delivered again is no witness for itself; ``rows_n`` and so on are the same over all rows.
    Words are kept apart by what is before them only as far as ``asked`` (prev, tok) may ask for it: by both words before, where the last two are asked for; by
    one, where a word before and a first letter are; else ``prev2``, or ``prev`` too, is null. So next to nothing but the vocabulary is shuffled."""
    pair, first = _bits(asked, "prev", "tok"), _bits(asked.select("prev", F.left("tok", F.lit(1)).alias("tok")), "prev", "tok")
    d = docs.groupBy("t").agg(F.count(F.lit(1)).alias("rows"))
    d = d.select(_tokens(F.col("t")).alias("a"), "rows").select("rows", F.inline(_contexts("a"))).where(~F.col("tok").isin(_STOP, _COLON))
    d = d.withColumn("prev2", F.when(_let_through(pair, F.col("prev"), F.col("tok")), F.col("prev2"))).withColumn("prev", F.when(_let_through(first, F.col("prev"), F.left("tok", F.lit(1))), F.col("prev")))
    stops, last = F.coalesce(F.col("next") == _STOP, F.lit(False)), F.col("next").isNull()
    each = {"n": F.lit(True), "ends": stops, "last": last, "inner": ~last}
    sums = [F.sum(x.cast("int")).alias(k) for k, x in each.items()] + [F.sum(F.when(x, F.col("rows")).otherwise(0)).alias(f"rows_{k}") for k, x in each.items()]
    return d.groupBy("prev2", "prev", "tok").agg(*sums)


def _prefixes(word: str, lengths: list[int]) -> Column:
    """A row for each proper prefix of a word that has one of ``lengths``."""
    return F.explode(F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n < F.length(word)), lambda n: F.substring(word, F.lit(1), n)))


def trie(words: DataFrame, lengths: list[int], rules: CutRules = CutRules()) -> DataFrame:
    """prefix, mass: the nodes of the trie of known words, with the times that longer words below each were seen; those of ``lengths`` letters."""
    known = words.where((F.col("inner") >= rules.known) & (F.length("tok") > 1) & (F.col("tok") != "0"))
    return known.select(_prefixes("tok", lengths).alias("tok"), "inner").groupBy("tok").agg(F.sum("inner").alias("mass"))


def truncated(docs: DataFrame, rules: CutRules = CutRules()) -> DataFrame:
    """doc_id, source and the evidence (``prefix``, ``limit``, ``unfinished``, ``open``) of each truncated text.

    Null, empty and blank texts, and texts without a letter or digit, are no cases. Rows delivered twice
    are cases each. A null source has its own limits. An empty table gives an empty table.
    """
    whole = tails(docs)
    candidate = whole.withColumn("z", F.right("t", F.lit(_MOST))).where(~(F.col("z").rlike("(?U)" + _END) & ~F.col("marked") & ~F.col("broken"))).withColumn("a", _tokens(F.col("t")))
    # the last token and what is before it; signs after the last token are passed over
    candidate = candidate.withColumn("a", F.when(F.try_element_at("a", F.lit(-1)).isin(_STOP, _COLON), F.slice("a", 1, F.size("a") - 1)).otherwise(F.col("a")))
    candidate = candidate.withColumn("end", F.try_element_at(_contexts("a"), F.lit(-1)))
    inside = lambda o, c: F.contains("t", F.lit(o)) & ~F.contains(F.substring_index("t", o, -1), F.lit(c))
    opened = inside("(", ")") | inside("[", "]") | inside("“", "”") & ~F.col("t").contains("„") | inside("«", "»") | inside("„", "“")
    c = stored(
        candidate.select(
            "doc_id", "source", "marked", "broken",
            F.length("text").alias("chars"), F.octet_length("text").alias("bytes"),
            F.col("end.prev2").alias("prev2"), F.col("end.prev").alias("prev"), F.col("end.tok").alias("tok"),
            F.col("z").rlike("(?U)" + _DASH).alias("dash"),
            F.col("z").rlike(_END).alias("ended"),
            F.col("z").rlike(r"(?U)[,;:’'‘(\[«“„/&-]$").alias("hanging"),
            F.col("z").rlike(r"(?U)[)\]”»]$").alias("closed"),
            opened.alias("inside"),
            F.array_contains("a", _STOP).alias("stops"),
        )
    )
    keys = c.where("tok IS NOT NULL").select("prev", "tok").distinct()
    lengths = sorted(r[0] for r in keys.select(F.length("tok")).distinct().collect())  # a number for each length there is
    three = stored(triples(whole, keys))
    seen = cut(three.where("prev IS NOT NULL").groupBy("prev", "tok").agg(*[F.sum(x).alias(x) for x in SUMS]))
    words = three.groupBy("tok").agg(*[F.sum(x).alias(x) for x in SUMS])
    of = lambda df, key, k: df.select(*key, *[F.col(x).alias(f"{x}{k}") for x in SUMS])
    # the trie below single words, and the same below the word before: what longer words it is seen to go on to
    nodes = seen.where((F.col("inner") > 0) & (F.length("tok") > 1)).select("prev", _prefixes("tok", lengths).alias("tok"), "inner")
    nodes = nodes.join(keys, ["prev", "tok"], "left_semi").groupBy("prev", "tok").agg(F.sum("inner").alias("mass2"))
    known = keys.join(of(seen, ["prev", "tok"], 2), ["prev", "tok"], "left").join(of(words, ["tok"], 1), "tok", "left").join(trie(words, lengths, rules), "tok", "left").join(nodes, ["prev", "tok"], "left")
    known = c.select(*TRIPLE).distinct().join(known, ["prev", "tok"], "left").join(of(three.where("prev2 IS NOT NULL"), TRIPLE, 3), TRIPLE, "left").fillna(0)
    unknown = F.col("mass") >= rules.below * F.greatest(F.col("inner1"), F.lit(0.02))
    # a pair that stops several texts and is never seen to go on to a longer word is a word of its own
    below = (F.col("inner2") == 0) & (F.col("mass2") >= 5) & ((F.col("n2") < 3) | (F.col("mass2") >= rules.below * F.col("n2")))
    prefix = (unknown & ((F.col("n2") < 3) | (F.col("mass2") > 0))) | below
    # a text without full stops may be a heading, used over and over: all its rows count
    verdict = known.select(*TRIPLE, prefix.alias("prefix"), _never(rules, rules.spared).alias("never"), _never(rules, 0, "rows_").alias("never0"))
    c = lookup_join(c, verdict, TRIPLE)
    named = F.coalesce("source", F.lit("\x00")).alias("_source")
    cuts = limits(docs, rules).groupBy(named).agg(F.collect_list(F.struct("unit", "size")).alias("cuts"))
    c = lookup_join(c.select("*", named), cuts, ["_source"])
    at_limit = F.coalesce(F.exists("cuts", lambda x: F.when(x["unit"] == "chars", F.col("chars").between(x["size"] - 1, x["size"])).otherwise(F.col("bytes").between(x["size"] - 3, x["size"]))), F.lit(False))
    limit = at_limit & (F.col("marked") | ~(F.col("ended") | F.col("dash") | F.col("closed")))
    sound = F.col("dash") | F.col("ended") | F.col("closed")
    word = F.col("tok").isNotNull()
    out = c.select(
        "doc_id", "source",
        (word & ~sound & F.coalesce("prefix", F.lit(False))).alias("prefix"),
        limit.alias("limit"),
        (word & ~sound & F.coalesce(F.when(F.col("stops"), F.col("never")).otherwise(F.col("never0")), F.lit(False))).alias("unfinished"),
        (word & (F.col("broken") | (~F.col("dash") & ~F.col("ended") & (F.col("hanging") | F.col("inside"))))).alias("open"),
    )
    return out.where("prefix OR limit OR unfinished OR open")


def per_source(docs: DataFrame, rules: CutRules = CutRules()) -> DataFrame:
    """source, texts, truncated, share: of the texts with content, how many of each source are truncated; and, of these, how many
    the trie and the lengths tell (``by_prefix``, ``by_limit``), and how many only the sequence of words or an open end does (``by_rest``)."""
    cases = truncated(docs, rules).groupBy("source").agg(
        F.count(F.lit(1)).alias("truncated"), F.count_if("prefix").alias("by_prefix"), F.count_if("limit").alias("by_limit"), F.count_if(~(F.col("prefix") | F.col("limit"))).alias("by_rest")
    )
    all_ = tails(docs).groupBy("source").agg(F.count(F.lit(1)).alias("texts"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("truncated", "by_prefix", "by_limit", "by_rest")]
    joined = all_.join(cases, all_["source"].eqNullSafe(cases["source"]), "left").select(all_["source"], "texts", *counts)
    return joined.withColumn("share", F.col("truncated") / F.col("texts"))
