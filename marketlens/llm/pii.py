"""Personal data: patterns find protected entities, corpus statistics find the terms that give them away. Column expressions only.

An entity is a value that a pattern finds (an address, a number). A term is a word of letters anywhere in a text, outside entities. As in information-theoretic
sanitisation, a term discloses an entity if their pointwise mutual information comes near the entity's own information:
log p(e|t) / p(e) >= ALPHA * log 1 / p(e). Probabilities are shares of different texts, counted over the whole corpus: copies of a text count
once. p(e|t) is smoothed towards p(e) with the weight of PRIOR texts, so pairs of a single text are judged by the same threshold, which they pass
in a corpus large enough for one text to be telling.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import Scratch

ALPHA = .9
#: Texts' worth of evidence for p(e) in the estimate of p(e|t).
PRIOR = 1
MIN_LETTERS = 3
#: Numbers of 64 bits in the sieve of disclosing terms (2 MB).
SIEVE = 1 << 18
TERM = r"\p{L}++"
FOUND = "array<struct<kind:int,start:int,end:int,value:string>>"
HITS = "array<struct<term:string,sure:boolean>>"
#: Matches are counted up in strides of so many.
STRIDE = 256
SPANS = "array<struct<start:int,end:int,sure:boolean>>"
EMAIL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """pattern: matches as the plain expression of the contract does, but without trying a run of characters from each of its places, and
    without recursion. needs: a character that every match has."""
    name: str
    pattern: str
    needs: str | None = None

    def valid_in(self, matches: Column) -> Callable[[Column], Column]:
        return lambda i: self.valid(F.get(matches, i))

    def valid(self, match: Column) -> Column:
        digits = F.regexp_replace(match, "[^0-9]", "")
        n = F.length(digits)
        if self.name == "ip":
            return ~F.exists(F.split(match, r"\."), lambda part: ~part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
        if self.name == "card":
            return n.between(13, 19) & F.when(n.between(13, 19), luhn(digits)).otherwise(False)
        if self.name == "phone":
            return n.between(9, 15)
        return F.lit(True)


KINDS = (
    Kind("email", rf"(?:\G|(?<![{EMAIL}]))[{EMAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)


def luhn(digits: Column) -> Column:
    """Check sum of a card number: every second digit from the right counts twice, nines cast out."""
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + luhn_digit(F.substr(digits, i, F.lit(1)).cast("int"), (n - i) % 2 == 1))
    return total % 10 == 0


def luhn_digit(d: Column, twice: Column) -> Column:
    return F.when(twice, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)


def located(matches: Column, gaps: Column, sizes: Column, wanted: Column, base: Column, value) -> Column:
    """Structs `value(match, start, end)` of the matches numbered in `wanted`: a match starts behind all gaps and matches before it.

    `sizes` holds the lengths of each gap with the match behind it and their sums by STRIDE, so that a start adds up few numbers however many matches there are.
    """
    def at(i):
        block = F.floor(i / STRIDE).cast("int")
        start = base + total(F.slice(sizes["sums"], 1, block)) + total(F.slice(sizes["own"], block * STRIDE + 1, i - block * STRIDE)) + F.length(F.get(gaps, i))
        return value(F.get(matches, i), start)
    return F.transform(wanted, at)


def total(numbers_: Column) -> Column:
    return F.aggregate(numbers_, F.lit(0), lambda s, x: s + x)


def piece_sizes(matches: Column, gaps: Column) -> Column:
    return F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))


def with_sums(own: Column) -> Column:
    sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(own) / STRIDE).cast("int")), lambda b: total(F.slice(own, b * STRIDE + 1, STRIDE)))
    return F.struct(own.alias("own"), sums.alias("sums"))


def numbers(array: Column) -> Column:
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.array().cast("array<int>"))


def with_found(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the entities of a text without nulls: kind number, start, end (code points, end exclusive) and value, by kind, then start."""
    made = df
    for i, kind in enumerate(KINDS):
        all_ = F.regexp_extract_all(F.col(text), F.lit(kind.pattern), F.lit(0))
        made = made.withColumn(f"{out}_m{i}", F.when(F.contains(F.col(text), F.lit(kind.needs)), all_).otherwise(F.array().cast("array<string>")) if kind.needs else all_)
    for i, kind in enumerate(KINDS):
        m = F.col(f"{out}_m{i}")
        made = made.withColumn(f"{out}_w{i}", F.filter(numbers(m), kind.valid_in(m)))
    for i, kind in enumerate(KINDS):
        w = F.col(f"{out}_w{i}")
        made = made.withColumn(f"{out}_g{i}", F.when(F.size(w) > 0, F.split(F.col(text), kind.pattern, -1)).otherwise(F.array().cast("array<string>")))
    for i in range(len(KINDS)):
        m, g = F.col(f"{out}_m{i}"), F.col(f"{out}_g{i}")
        made = made.withColumn(f"{out}_l{i}", F.when(F.size(g) > 0, piece_sizes(m, g)))
    for i in range(len(KINDS)):
        made = made.withColumn(f"{out}_s{i}", with_sums(F.col(f"{out}_l{i}")))
    lists = []
    for i in range(len(KINDS)):
        m, g, s, w = (F.col(f"{out}_{x}{i}") for x in "mgsw")
        lists.append(located(m, g, s, w, F.lit(0), lambda value, start, i=i: F.struct(F.lit(i).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))))
    return made.withColumn(out, F.concat(*lists).cast(FOUND)).drop(*[f"{out}_{x}{i}" for x in "mgwls" for i in range(len(KINDS))])


def prepared(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, mark, text) with null texts made empty; id and mark, a hash of the text, tell rows apart that may have different texts."""
    body = F.coalesce(docs[text], F.lit(""))
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(body).alias("mark"), body.alias("text"))


def masked(text: Column, found: Column) -> Column:
    """The text with a space for each character of an entity, so that places stay."""
    spans = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast("string").alias("label"))))
    return F.when(F.size(found) > 0, rewritten(text, spans)).otherwise(text)


def bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """`function` of a value that is made only once, although lambdas in it use it often."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def rewritten(text: Column, spans: Column) -> Column:
    """The text with labels in place of spans (start, end, label), which come by start; a null label is a space for each character.

    Of overlapping spans the first label stands for both. Spans are taken in strides, and each stride's part of the text is cut out once, as the way to a
    place in a text grows with the text.
    """
    def stride(state, b):
        some = F.slice(spans, b * STRIDE + 1, STRIDE)
        stop = F.greatest(state["at"], F.array_max(F.transform(some, lambda s: s["end"])))

        def inside(piece):
            def step(inner, s):
                gap = F.substr(piece, inner["at"] - state["at"] + 1, F.greatest(s["start"] - inner["at"], F.lit(0)))
                blank = F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], inner["at"]), F.lit(0)))
                label = F.when(s["label"].isNull(), blank).when(s["start"] >= inner["at"], s["label"]).otherwise("")
                return F.struct(F.greatest(inner["at"], s["end"]).alias("at"), F.concat(inner["out"], F.array(gap, label)).alias("out"))

            return F.aggregate(some, F.struct(state["at"].alias("at"), F.array().cast("array<string>").alias("out")), step, lambda s: F.struct(s["at"].alias("at"), F.array_join(s["out"], "").alias("made")))

        done = bound(F.substr(text, state["at"] + 1, stop - state["at"]), inside)
        return bound(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["out"], F.array(d["made"])).alias("out")))

    strides = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / STRIDE).cast("int"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(strides, start, stride, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, s["at"] + 1, F.length(text))))


def distinct_terms(masked_text: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(masked_text, F.lit(TERM), F.lit(0)))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= MIN_LETTERS), F.lower))


def with_term_spans(df: DataFrame, text: str, found: str, hits: str, out: str) -> DataFrame:
    """Adds the spans (start, end, sure) of all occurrences of the terms in `hits`, by start.

    Words and terms are sorted together, so each word meets its term in one pass; a second pass over the words found adds up lengths.
    """
    word = f"{out}_w"
    plain = df.withColumn(f"{out}_x", masked(F.col(text), F.col(found)))
    cut = plain.withColumn(word, F.when(F.size(hits) > 0, F.struct(F.regexp_extract_all(f"{out}_x", F.lit(TERM), F.lit(0)).alias("m"), F.split(f"{out}_x", TERM, -1).alias("g"))))
    m, g = F.col(f"{word}.m"), F.col(f"{word}.g")
    both = F.concat(F.transform(hits, lambda h: F.struct(h["term"].alias("w"), F.lit(-1).alias("i"), h["sure"].alias("sure"))),
                    F.transform(m, lambda w, i: F.struct(F.lower(w).alias("w"), i.alias("i"), F.lit(False).alias("sure"))))

    def meet(state, s):
        hit = F.struct(s["i"].alias("i"), state["sure"].alias("sure"))
        same = F.struct(state["w"].alias("w"), state["sure"].alias("sure"), F.concat(state["out"], F.array(hit)).alias("out"))
        return F.when(s["i"] < 0, F.struct(s["w"].alias("w"), s["sure"].alias("sure"), state["out"].alias("out"))).when(s["w"] == state["w"], same).otherwise(state)

    none = F.struct(F.lit("").alias("w"), F.lit(False).alias("sure"), F.array().cast("array<struct<i:int,sure:boolean>>").alias("out"))
    wanted = F.aggregate(F.array_sort(both), none, meet, lambda s: F.array_sort(s["out"]))

    def size(parts):
        return F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))

    def place(state, s):
        start = state["at"] + size(F.slice(g, state["next"] + 1, s["i"] - state["next"] + 1)) + size(F.slice(m, state["next"] + 1, s["i"] - state["next"]))
        end = start + F.length(F.get(m, s["i"]))
        span = F.struct(start.alias("start"), end.alias("end"), s["sure"].alias("sure"))
        return F.struct((s["i"] + 1).alias("next"), end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    zero = F.struct(F.lit(0).alias("next"), F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    spans = F.aggregate(wanted, zero, place, lambda s: s["out"])
    return cut.withColumn(out, F.when(F.size(hits) > 0, spans).otherwise(F.array().cast(SPANS))).drop(f"{out}_x", word)


def disclosing(rows: DataFrame, scratch: Scratch, alpha: float = ALPHA) -> DataFrame:
    """Terms that disclose an entity, and whether they stand in no text without one that they disclose (sure), from rows (mark, entities, terms).

    All counts are of different texts and added up before the shuffle; a term or entity in a third of all texts is one row per task. Entities of the
    same texts are one class. Of a text's terms only those rare enough to disclose one of its classes are paired with them.
    """
    copies = scratch.table("copies", rows.groupBy("mark").agg(F.count("*").alias("copies")).filter("copies > 1"))
    total = rows.select("mark").distinct().agg(F.count("*").alias("texts"))
    # The rows of a text with n copies are n of those counted with n.
    words = rows.select("mark", "terms").join(copies, "mark", "left").select(F.coalesce("copies", F.lit(1)).alias("copies"), F.explode("terms").alias("term"))
    spread = words.groupBy("term", "copies").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum((F.col("n") / F.col("copies")).cast("long")).alias("with_term"))
    spread = scratch.table("spread", spread)
    private = scratch.table("private", rows.filter(F.size("entities") > 0).select("mark", "entities", "terms").dropDuplicates(["mark"]))
    stands = private.select("mark", F.explode("entities").alias("entity"))
    held = scratch.table("held", stands.groupBy("entity").agg(F.count("*").alias("with_entity"), F.min("mark").alias("least"), F.bit_xor("mark").alias("crossed")))
    base = F.col("with_entity") / F.col("texts")
    threshold = F.pow(base, F.lit(1 - alpha))
    classes = stands.join(held, "entity").select("mark", "with_entity", "least", "crossed").distinct().withColumn("texts", total.scalar()).filter(base < 1)
    classes = scratch.table("classes", classes.withColumn("most", (F.col("with_entity") + PRIOR * base) / threshold - PRIOR + 1e-6))
    near = private.select("mark", F.explode("terms").alias("term")).join(spread.filter(F.col("with_term") <= classes.agg(F.max("most")).scalar()), "term")
    pairs = near.join(classes, "mark").filter(F.col("with_term") <= F.col("most"))
    both = pairs.groupBy("term", "with_term", "with_entity", "least", "crossed", "texts").agg(F.count("*").alias("both"))
    share = (F.col("both") + PRIOR * base) / (F.col("with_term") + PRIOR)
    return both.filter(share >= threshold).groupBy("term").agg(F.max(F.col("both") >= F.col("with_term")).alias("sure"))


def sieve_place(term: str) -> tuple[Column, Column]:
    h = F.xxhash64(term)
    return F.pmod(h, F.lit(SIEVE)), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")


def sieve(terms: DataFrame) -> DataFrame:
    """One row of SIEVE numbers in which each term has set a bit. It only saves rows before a join; terms that share a bit are told apart there."""
    i, bit = sieve_place("term")
    filled = terms.select(i.alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("id").agg(F.bit_or("b").alias("b"))
    numbers_ = terms.sparkSession.range(SIEVE).join(filled, "id", "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return numbers_.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "b"))), lambda s: s["b"]).alias("bits"))


def in_sieve(bits: Column, term: str) -> Column:
    i, bit = sieve_place(term)
    return F.call_function("shiftright", F.get(bits, i.cast("int")), bit).bitwiseAND(F.lit(1)) == 1


def disclosed(docs: DataFrame, scratch: Scratch, alpha: float) -> DataFrame:
    """(doc_id, mark, hits): the disclosing terms (term, sure) of each prepared text that has some, wherever they stand in it."""
    entity = F.array_distinct(F.transform("found", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))
    plain = with_found(docs, "text", "found").withColumn("plain", masked(F.col("text"), F.col("found")))
    rows = scratch.table("words", plain.select("doc_id", "mark", entity.alias("entities"), distinct_terms(F.col("plain")).alias("terms")))
    telling = scratch.table("telling", disclosing(rows, scratch, alpha))
    bits = scratch.table("sieve", sieve(telling))
    met = rows.select("doc_id", "mark", F.explode("terms").alias("term")).filter(in_sieve(bits.scalar(), "term")).join(telling, "term")
    hits = scratch.table("hits", met.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("term", "sure")).alias("hits")))  # terms of one text
    scratch.drop("words", "copies", "spread", "private", "held", "classes", "telling", "sieve")
    return hits


def find_private(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """One row per document: doc_id, mark, found (entities) and terms (start, end, sure).

    A disclosing term is found at each of its places, in texts without the entity too. Null and empty texts have no spans. Repeated rows get a row each
    with the same spans; an empty table gives an empty result; a null id is kept; other columns are not read.
    """
    inner = prepared(docs, doc_id, text)
    hits = disclosed(inner, Scratch(docs.sparkSession), alpha).toDF("h_id", "h_mark", "hits")
    made = inner.join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("mark") == F.col("h_mark")), "left")
    made = with_found(made.withColumn("hits", F.coalesce("hits", F.array().cast(HITS))), "text", "found")
    return with_term_spans(made, "text", "found", "hits", "terms").select("doc_id", "mark", "found", "terms")


def of_kind(found: Column, i: int) -> Column:
    return F.filter(found, lambda s: s["kind"] == i)


def span_list(found: Column, terms: Column | None = None) -> Column:
    """kind:start:end of all spans, comma-joined: entities by kind and start, then terms by start."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    spans = F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    if terms is not None:
        spans = F.concat(spans, F.transform(terms, lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"])))
    return F.array_join(spans, ",")


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """The documents with entities generalised to their kind, as [EMAIL]; terms that are sure to disclose are removed, other disclosing ones become [TERM].

    Null texts stay null. Of overlapping spans the first stands for both. Columns keep their names and order, whatever these are.
    """
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.toDF(*names.values())
    key, body = F.col(names[doc_id]).cast("long"), F.coalesce(F.col(names[text]), F.lit(""))
    hits = disclosed(prepared(docs, doc_id, text), Scratch(docs.sparkSession), alpha).toDF("h_id", "h_mark", "hits")
    joined = inner.withColumn("body", body).join(hits, key.eqNullSafe(F.col("h_id")) & (F.xxhash64(body) == F.col("h_mark")), "left")
    found = with_found(joined.withColumn("hits", F.coalesce("hits", F.array().cast(HITS))), "body", "found")
    joined = with_term_spans(found, "body", "found", "hits", "terms")
    labels = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])
    entities = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(labels, s["kind"]).alias("label")))
    others = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["sure"], "").otherwise("[TERM]").alias("label")))
    planned = joined.withColumn("spans", F.array_sort(F.concat(entities, others)))
    clean = F.when(F.size("spans") > 0, rewritten(F.col("body"), F.col("spans"))).otherwise(F.col(names[text]))
    return planned.select(*[clean.alias(c) if c == text else F.col(n).alias(c) for c, n in names.items()])
