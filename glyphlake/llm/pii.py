"""Operator 7: personal data by bootstrapped contextual extraction.

DataFrame functions only. Fixed patterns find emails, addresses, cards and phones; long hexadecimal keys count as seeds
too. What stands around seeds makes lexical patterns: a key word with its separator (``token = "``), the word before, the
word after. Patterns and their instances form a bipartite graph on which scores go back and forth for a few rounds: a
pattern is worth the share of its occurrences that are believed, an instance what its patterns are worth together, and
instances found so support further patterns. Patterns that end with high confidence then mark every identifier beside
them, also of forms that no fixed pattern knows.

Texts are searched in blocks that end where no span can lie across, so the work grows with a text's length alone. (A block ends at
the first line end, or space after a letter, beyond BLOCK characters; numbers that single spaces separate have neither.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import SPACES, staged, unstage

#: Kinds in the order of ties, and their patterns. Possessive loops and the look-behind (or the end of the last
#: match) find what the plain patterns find, without trying each place of a long run of characters again.
KINDS = ("email", "ip", "card", "phone", "id")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An identifier-like token: six characters or more, a digit among them.
TOKEN = r"(?:\G|(?<![A-Za-z0-9_-]))(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+"
#: What stands before an instance: a word, a separator and an opening quote or bracket; or a word and white space. After it: a word.
CONTEXT = r"([^\s:=#]{1,30}\s?[:=#]\s?[\"'(\[<]?)$"
WORD_BEFORE = r"(?:^|\s)(\S{1,30})\s$"
WORD_AFTER = r"^[\"')\]>,;.!?]{0,2}\s(\S{1,30})(?:\s|$)"
#: Characters before and after an instance that contexts are read from, enough for the three patterns above.
AROUND = 40
#: Characters after which a block of text ends at the next safe place; elements that a running sum takes in a step.
BLOCK, STEP = 1500, 64
_BLOCKS = rf"(?s).{{{BLOCK}}}.*?(?:\n|(?<=[A-Za-z])\x20|\z)|.+"
HEX_KEY = r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]{32,}$"
#: Rounds of scoring; believed instances (the sum of their scores) and share of believed occurrences for a pattern to count.
ROUNDS, SUPPORT, CONFIDENCE = 3, 3, 0.7
#: Most believable contexts that become part of the plan; beyond, tokens are joined with the table of contexts.
CONTEXTS = 1000

_SPAN = "array<struct<s:int,e:int,v:string,keys:array<string>>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, computed once: a lambda's variable, where a plain expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grown(a: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What op makes of 0 and the 0, 1, 2... first elements. An array that an aggregate grows is copied with each element."""
    return F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))


def _running(a: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element, what op (associative, 0 its neutral value) makes of those before it; long arrays go in steps of STEP."""

    def stepped(own: Column) -> Column:
        steps = F.sequence(F.lit(0), F.ceil(F.size(own) / STEP).cast("int") - 1)

        def part(k: Column) -> Column:
            return F.transform(F.sequence(k * STEP, F.least(F.size(own), (k + 1) * STEP) - 1), lambda i: F.get(own, i))

        def joined(parts: Column) -> Column:
            base = _grown(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), op)), op)
            return _let(base, lambda start: F.flatten(F.transform(parts, lambda p, k: F.transform(F.slice(_grown(p, op), 1, F.size(p)), lambda x: op(x, F.get(start, k))))))

        return _let(F.transform(steps, part), joined)

    return _let(a, lambda own: F.when(F.size(own) <= STEP, _grown(own, op)).otherwise(stepped(own)))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _keys(left: Column, right: Column) -> Column:
    """Contexts of an instance, each with a mark of its kind: separator, word before, word after."""
    found = (("=", left, CONTEXT), ("<", left, WORD_BEFORE), (">", right, WORD_AFTER))
    every = F.array(*[F.concat(F.lit(mark), F.lower(F.regexp_extract(side, pattern, 1))) for mark, side, pattern in found])
    return F.filter(every, lambda x: F.length(x) > 1)


def _spans(text: Column, at: Column, before: Column, after: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """Leftmost, non-overlapping matches in a block that begins at ``at``, in code points (s, e exclusive), with their contexts;
    failing ones go.

    The texts between matches and the matches themselves take turns, so their lengths add up to the places.
    """

    def placed(turns: Column) -> Column:
        def of(starts: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                s = at + F.get(starts, i) + F.length(x["g"])
                left = F.right(F.concat(F.when(i == 0, before).otherwise(""), x["g"]), F.lit(AROUND))
                later = F.get(turns, i + 1)
                right = F.left(F.concat(later["g"], F.when(later["m"].isNull(), after).otherwise("")), F.lit(AROUND))
                return F.when(x["m"].isNotNull() & valid(x["m"]), F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("v"), _keys(left, right).alias("keys")))

            return F.filter(F.transform(turns, span), lambda x: x.isNotNull())

        return _let(_running(F.transform(turns, lambda x: F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0))), _plus), of)

    def some(found: Column) -> Column:
        turns = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        return F.when(F.size(found) == 0, F.array().cast(_SPAN)).otherwise(_let(turns, placed))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """14 to 19 digits whose weighted sum ends in 0: from the right, every second digit doubled and its digits added."""
    d = F.transform(F.split(F.reverse(_digits(m)), ""), lambda c: F.when(c == "", 0).otherwise(c.cast("int")))
    weighed = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    total = F.aggregate(weighed, F.lit(0), lambda a, x: a + x)
    return F.when(F.length(_digits(m)).between(14, 19), total % 10 == 0).otherwise(False)


def _octets(m: Column) -> Column:
    def small(p: Column) -> Column:
        short = F.regexp_replace(p, "^0+(?=.)", "")
        return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))

    return F.forall(F.split(m, r"\."), small)


def _overlap(a: Column, b: Column) -> Column:
    return (b["s"] < a["e"]) & (a["s"] < b["e"])


def found(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, and arrays of spans email, ip, card, phone and token of each whole text (null: empty); tokens overlap no other span."""
    none = F.array().cast(_SPAN)

    def in_block(b: Column, at: Column, before: Column, after: Column) -> Column:
        digit = b.rlike("[0-9]")
        kinds = (
            (b.contains("@"), EMAIL, lambda m: F.lit(True)),
            (digit & b.contains("."), IP, _octets),
            (digit, CARD, _luhn),
            (digit & b.contains("+"), PHONE, lambda m: F.length(_digits(m)).between(10, 15)),
        )
        own = F.struct(*[F.when(may, _spans(b, at, before, after, pattern, valid)).otherwise(none).alias(k) for k, (may, pattern, valid) in zip(KINDS, kinds, strict=False)])
        tokens = F.when(digit, _spans(b, at, before, after, TOKEN, lambda m: F.lit(True))).otherwise(none)

        def with_tokens(x: Column) -> Column:
            apart = lambda t: ~F.exists(F.concat(*[x[k] for k in KINDS[:4]]), lambda y: _overlap(t, y))
            return F.struct(*[x[k].alias(k) for k in KINDS[:4]], F.filter(tokens, apart).alias("token"))

        return _let(own, with_tokens)

    def in_blocks(blocks: Column) -> Column:
        def placed(starts: Column) -> Column:
            def one(b: Column, i: Column) -> Column:
                before = F.right(F.coalesce(F.get(blocks, i - 1), F.lit("")), F.lit(AROUND))
                return in_block(b, F.get(starts, i), before, F.left(F.coalesce(F.get(blocks, i + 1), F.lit("")), F.lit(AROUND)))

            return F.transform(blocks, one)

        return _let(_running(F.transform(blocks, lambda b: F.length(b)), _plus), placed)

    names = (*KINDS[:4], "token")
    text = F.coalesce(F.col("text"), F.lit(""))
    every = _let(F.regexp_extract_all(text, F.lit(_BLOCKS), F.lit(0)), in_blocks)
    joined = _let(every, lambda bs: F.struct(*[F.flatten(bs.getField(k)).alias(k) for k in names]))
    empty = F.struct(*[none.alias(k) for k in names])
    # A generator, so that the whole is computed once and not for each column that reads it.
    own = F.inline(F.array(F.struct(F.when(text.rlike("[0-9@]"), joined).otherwise(empty).alias("_found"))))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_none")).alias("_kept")  # apart, so that no name clashes
    return docs.select(kept, own).select(*[F.col("_kept").getField(c).alias(c) for c in keep], *[F.col("_found").getField(k).alias(k) for k in names])


def patterns(docs: DataFrame) -> DataFrame:
    """(key, conf) of the contexts that seeds, and what they lead to, make believable.

    A pattern of a separator is held against all identifiers behind it, one of a word against all occurrences of the word in
    the corpus, so that frequent words that now and then stand beside a seed count little.
    """
    base = F.concat(*[F.transform(k, lambda x: F.struct(x["v"].alias("v"), x["keys"].alias("keys"), F.lit(1).alias("seed"))) for k in KINDS[:4]])
    tokens = F.transform("token", lambda x: F.struct(x["v"].alias("v"), x["keys"].alias("keys"), x["v"].rlike(HEX_KEY).cast("int").alias("seed")))
    each = found(docs).select(F.explode(F.concat(base, tokens)).alias("x")).select(F.explode("x.keys").alias("key"), F.xxhash64("x.v").alias("v"), "x.seed")
    pairs = staged(each.groupBy("key", "v").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "pairs")
    often = staged(pairs.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("own")).where(F.col("m") >= SUPPORT).select("key", "own"), "often")
    asked = often.where(~F.col("key").startswith("=")).select(F.substring("key", 2, 1 << 30).alias("word")).distinct()
    words = docs.select(F.explode(F.split(F.lower("text"), SPACES)).alias("word")).join(asked, "word", "left_semi").groupBy("word").agg(F.count("*").alias("all"))
    word = F.when(~F.col("key").startswith("="), F.substring("key", 2, 1 << 30))
    totals = often.withColumn("word", word).join(words, "word", "left").select("key", F.greatest("own", F.coalesce("all", F.lit(0))).alias("total"))
    edges = staged(pairs.join(totals, "key"), "edges")
    unstage(pairs, often)
    # Each round reads the one before once, so that rounds need no staging: every staged table is a file a partition, however small.
    scores = edges.groupBy("v").agg(F.max("seed").cast("double").alias("score"))
    for k in range(ROUNDS):
        weighed = edges.join(scores, "v").groupBy("key")
        worth = weighed.agg((F.sum(F.col("n") * F.col("score")) / (F.max("total") + 0.5)).alias("conf"), F.sum("score").alias("support"))
        if k + 1 < ROUNDS:
            doubt = F.sum(F.log(1 - F.least("conf", F.lit(0.99))))
            believed = edges.join(worth.where(F.col("support") >= SUPPORT), "key", "left").groupBy("v")
            scores = believed.agg(F.when(F.max("seed") == 1, 1.0).otherwise(F.coalesce(1 - F.exp(doubt), F.lit(0.0))).alias("score"))
    good = staged(worth.where((F.col("conf") >= CONFIDENCE) & (F.col("support") >= SUPPORT)).select("key", "conf"), "good")
    unstage(edges)
    return good


def identify(docs: DataFrame, *keep: str) -> DataFrame:
    """keep and the arrays base and spans of (s, kind, e) in order, and counts n_email, n_ip, n_card, n_phone.

    base has the fixed patterns' spans; spans also those of kind ``id`` that a believable context stands beside and no base span
    overlaps. Null and empty texts have none; very long ones are searched whole, block by block; repeated rows are each
    searched; an empty table gives no rows. Columns besides text and keep are ignored; those of keep must not bear the
    names of the result's own.
    """
    good = patterns(docs)
    few = [r["key"] for r in good.select("key").limit(CONTEXTS + 1).collect()]
    place = lambda x, kind: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_none")).alias("_kept")
    own = docs.select(kept, "text")
    if len(few) <= CONTEXTS:
        believed = F.filter("token", lambda x: F.exists(x["keys"], lambda k: k.isin(few))) if few else F.slice("token", 1, 0)
        rows = found(own, "_kept").withColumn("more", F.transform(believed, lambda x: place(x, "id")))
    else:
        rows = staged(found(own, "_kept").withColumn("row", F.monotonically_increasing_id()), "found")
        tokens = rows.select("row", F.explode("token").alias("x")).select("row", place(F.col("x"), "id").alias("x"), F.explode("x.keys").alias("key"))
        # Written first, so that the planner knows its size and copies it to all tasks only where it is small.
        more = staged(tokens.join(good, "key", "left_semi").groupBy("row").agg(F.collect_set("x").alias("more")), "more")
        rows = rows.join(more, "row", "left")
    placed = lambda kind: F.transform(kind, lambda x: place(x, kind))
    base = F.array_sort(F.concat(*[placed(k) for k in KINDS[:4]]))
    spans = F.when(F.coalesce(F.size("more"), F.lit(0)) <= 0, F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    out = rows.select("_kept", "more", base.alias("base"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]])
    return out.select(*[F.col("_kept").getField(c).alias(c) for c in keep], "base", spans.alias("spans"), *[f"n_{k}" for k in KINDS[:4]])


def spelled(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap, the first to begin stands for all.

    The text is cut into blocks of BLOCK characters, and spans at the blocks' borders, so that each cut counts characters in its own
    block alone. Blocks and spans in order take turns: each writes the text from its end to the next one's begin.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    number = lambda x: F.floor(x / BLOCK).cast("int")

    def apart(reach: Column) -> Column:
        """Spans cut to what lies behind all before them: (s, e, w), w what to write."""

        def one(x: Column, i: Column) -> Column:
            before = F.get(reach, i)
            return F.struct(F.greatest(x["s"], before).alias("s"), x["e"].alias("e"), F.when(x["s"] >= before, F.get(names, x["k"])).otherwise("").alias("w"))

        return F.filter(F.transform(spans, one), lambda x: x["s"] < x["e"])

    def parts(x: Column) -> Column:
        """A span's parts: (b, s, e, w), places in block b."""

        def part(b: Column) -> Column:
            begin, end = F.greatest(x["s"] - b * BLOCK, F.lit(0)), F.least(x["e"] - b * BLOCK, F.lit(BLOCK))
            return F.struct(b.alias("b"), begin.alias("s"), end.alias("e"), F.when(b == number(x["s"]), x["w"]).otherwise("").alias("w"))

        return F.transform(F.sequence(number(x["s"]), number(x["e"] - 1)), part)

    def joined(blocks: Column) -> Column:
        def filled(cuts: Column) -> Column:
            def write(x: Column, i: Column) -> Column:
                after = F.get(cuts, i + 1)
                to = F.when(after["b"] == x["b"], after["s"]).otherwise(F.lit(BLOCK))
                return F.concat(x["w"], F.substring(F.get(blocks, x["b"]), x["e"] + 1, to - x["e"]))

            return F.array_join(F.transform(cuts, write), "")

        heads = F.transform(blocks, lambda t, b: F.struct(b.alias("b"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("").alias("w")))
        cut = _let(_running(F.transform(spans, lambda x: x["e"]), lambda a, b: F.greatest(a, b)), apart)
        return _let(F.array_sort(F.concat(heads, F.flatten(F.transform(cut, parts)))), filled)

    return _let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)), joined)
