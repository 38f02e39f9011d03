"""Personal data: base spans by pattern, more by what the corpus says about words; DataFrame functions only.

Base kinds are email, ip, card and phone, each found on its own in the whole text, leftmost first;
matches that fail their kind's test (parts over 255, Luhn, number of digits) are dropped. Patterns
are possessive and anchored to where a match can begin, so that no text makes them slow or deep.
Offsets are prefix sums over the pieces between matches, in blocks of about the root of their number,
so a text with very many matches costs little more than linear time.

The method estimates from the whole corpus how much of a protected entity's information a word
reveals. A word is a run of letters; entities are the values found (an address, a number) and their kinds.

- A word reveals a kind if the pointwise mutual information of word and kind over documents is at least
  the share `disclosure` of the kind's own information content, seen in `support` documents with it, and
  in documents that hold at least `support` different values of it: every value of a document counts
  (copies of one document aren't evidence, in whatever order its values stand).
- A word reveals one entity if it stands within WINDOW characters of that value in at least
  `entity_support` different texts, and knowing that a text has the word leaves at most `bits_left` bits
  of the information that the text has this value.

Such a word is a term (its span's kind is `term`) and is generalised in the text like the entities
themselves. Pairs of word and value are drawn for few words: for kinds those that pass the test of
mutual information, for entities those next to a value, so pairs grow with the number of values.

Spans are code points, end exclusive. sanitise() replaces the union of all spans by labels.

Defined results: null text is empty (no spans); repeated rows and copies have equal spans; an empty
table gives no rows; extra columns are kept by sanitise() and ignored by find(); a null doc_id stays null.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import few, forget, row_key, settle

# The kinds in their order, with pattern, the quick test that most texts fail, and label.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: What ends a word: everything in ASCII but the letters.
NOT_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"

SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"

#: Characters on each side of a value whose words stand by it; characters of a block of a text.
WINDOW, BLOCK = 80, 1024


def _maybe(kind: str) -> Column:
    """A cheap test that every text with a span of the kind passes."""
    if kind == "email":
        return F.col("text").contains("@")
    if kind == "phone":
        return F.col("text").contains("+")
    # the least digits of each; a start is tried once for each digit and fails within a few characters
    return F.col("text").rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]" if kind == "ip" else r"[0-9](?:[\x20-]?[0-9]){13}")


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]+", "")
    n = F.length(digits)
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return (n >= 14) & (n <= 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _once(value: Column, use) -> Column:
    """use(value), with value computed once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(numbers: Column, both) -> Column:
    """The running fold of an array of ints by `both` (sum or maximum): in blocks, as appending copies an array."""

    def fold(part: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.aggregate(part, none, lambda acc, x: F.array_append(acc, F.coalesce(both(F.get(acc, F.size(acc) - 1), x), x)))

    def of(x: Column) -> Column:
        wide = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int"))
        count = F.ceil(F.size(x) / wide).cast("int")

        def whole(width: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda k: fold(F.slice(x, k * width + 1, width)))
            return _once(blocks, joined)

        def joined(blocks: Column) -> Column:
            last = F.transform(blocks, lambda b: F.get(b, F.size(b) - 1))
            return _once(fold(last), lambda carry: F.flatten(F.transform(blocks, lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda v: both(F.get(carry, k - 1), v))))))

        return F.when(F.size(x) == 0, x).otherwise(_once(wide, whole))

    return _once(numbers, of)


def added(a: Column, b: Column) -> Column:
    return a + b


def placed(text: Column, pattern: Column, rank: int, valid=lambda m: F.lit(True)) -> Column:
    """Spans of all valid matches: the lengths of matches and of the pieces between them give the offsets."""

    def spans(found: Column) -> Column:
        pieces = F.split(text, pattern)
        lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
        span = F.zip_with(running(lengths, added), found, lambda end, m: F.struct((end - F.length(m)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), m.alias("value")))
        return F.filter(span, lambda s: valid(s["value"]))

    # most texts have numbers, few have a valid one: offsets are made only for those
    return _once(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.exists(found, valid), spans(found)).otherwise(F.array().cast(SPAN)))


def blocks_of(text: Column) -> Column:
    """The text in blocks of BLOCK characters, so that a part far inside is reached at once."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, at: Column, length: Column) -> Column:
    """`length` characters of the text from `at` on."""
    first = F.floor(at / BLOCK).cast("int")
    some = F.slice(blocks, first + 1, F.floor((at + length) / BLOCK).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), at - first * BLOCK + 1, length)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with a column of valid spans for each kind (null where the quick test fails)."""
    made = {
        f"in_{k}": F.when(_maybe(k), placed(F.col("text"), F.lit(PATTERNS[k]), i, partial(_valid, k)))
        for i, k in enumerate(KINDS)
    }
    return docs.withColumns(made)


def words_of(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(text, NOT_LETTERS)), "")


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _value(s: Column) -> Column:
    """A value as one number, a hash with the kind in its last two bits: arrays of structs are slow to make distinct."""
    return F.shiftleft(F.xxhash64(s["value"]), 2).bitwiseOR(s["rank"].cast("long"))


def _kind(value: Column) -> Column:
    return value.bitwiseAND(F.lit(3)).cast("int")


def entities(found: DataFrame) -> DataFrame:
    """(words, values, near, copy) of the documents of found(text, in_email, ...) that hold personal data.

    values are the document's distinct values, near the words by each occurrence of a value, copy a hash of the text.
    """
    spans = F.concat(*(F.coalesce(F.col(f"in_{k}"), F.array().cast(SPAN)) for k in KINDS))
    outside = F.regexp_replace("text", F.lit(PATTERNS["email"]), F.lit(" "))  # an address doesn't reveal itself

    def beside(blocks: Column):
        def words(s: Column) -> Column:
            low = F.greatest(s["start"] - WINDOW, F.lit(0))
            # the outermost pieces may be parts of words
            before = F.when(low > 0, F.regexp_replace(cut(blocks, low, s["start"] - low), r"^[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "")).otherwise(cut(blocks, low, s["start"] - low))
            after = F.regexp_replace(cut(blocks, s["end"], F.lit(WINDOW)), r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+$", "")
            text = F.regexp_replace(F.concat(before, F.lit(" "), after), r"[^\s]*@[^\s]*", " ")
            return F.struct(_value(s).alias("v"), words_of(text).alias("words"))

        return words

    near = _once(blocks_of(F.col("text")), lambda b: F.transform(F.col("spans"), beside(b)))
    values = F.array_distinct(F.transform("spans", _value))
    held = found.select("text", spans.alias("spans"), words_of(outside).alias("words")).where(F.size("spans") > 0)
    return held.select("words", values.alias("values"), near.alias("near"), F.xxhash64("text").alias("copy"))


def revealing_terms(found: DataFrame, *, disclosure: float, support: int, entity_support: int, bits_left: float) -> DataFrame:
    """(term): words of found(text, in_email, ...) that reveal a kind or an entity, from counts over all rows."""
    every = range(len(KINDS))
    told = settle(entities(found), "entities")
    has = [F.exists("values", partial(lambda i, v: _kind(v) == i, i)) for i in every]
    kinds = told.select("words", "values", *(h.alias(f"h{i}") for i, h in enumerate(has)))
    # texts, not documents, count for an entity: repeats of a text are no evidence
    beside = told.select("copy", F.explode("near").alias("e")).select("copy", "e.v", F.explode("e.words").alias("term")).distinct()
    together = settle(beside.groupBy("term", "v").agg(F.count(F.lit(1)).alias("n_texts")).where(F.col("n_texts") >= entity_support), "together")
    near = kinds.select(F.explode("words").alias("term"), *(f"h{i}" for i in every)).groupBy("term").agg(*(F.count_if(f"h{i}").alias(f"c{i}") for i in every))
    known = together.select("term").distinct().withColumn("beside", F.lit(True))
    near = near.join(known, "term", "left").where(_any(F.col(f"c{i}") >= support for i in every) | F.col("beside").isNotNull())
    near = settle(near.drop("beside"), "near")
    all_words = found.select(F.explode(words_of(F.col("text"))).alias("term"))
    counts = settle(all_words.join(few(near), "term").groupBy("term", *(f"c{i}" for i in every)).agg(F.count(F.lit(1)).alias("n_term")), "counts")
    n = found.count()
    of = kinds.agg(*(F.count_if(f"h{i}") for i in every)).first()

    def tells(i: int) -> Column:
        if not of[i] or of[i] == n:
            return F.lit(False)
        information = F.log(F.lit(n / of[i]))
        mutual = F.log(F.col(f"c{i}") * F.lit(n / of[i]) / F.col("n_term"))
        return (F.col(f"c{i}") >= support) & (mutual >= disclosure * information)

    able = settle(counts.where(_any(map(tells, every))).select("term", *(tells(i).alias(f"t{i}") for i in every)), "able")
    # different values: for the few words that are left, of every value of their documents
    some = kinds.select(F.explode("words").alias("term"), "values").join(few(able), "term")
    pairs = some.select("term", F.explode("values").alias("v"), *(f"t{i}" for i in every)).where(_any((_kind(F.col("v")) == i) & F.col(f"t{i}") for i in every))
    seen = pairs.select("term", "v").distinct().groupBy("term", _kind(F.col("v")).alias("kind")).agg(F.count(F.lit(1)).alias("n_values"))
    of_kind = seen.where(F.col("n_values") >= support).select("term")

    sure = together.join(few(counts, columns=("term", "n_term")), "term")
    of_entity = sure.where(F.log2(F.col("n_term") / F.col("n_texts")) <= bits_left).select("term")
    out = settle(of_kind.unionByName(of_entity).distinct(), "revealing")
    forget(told, together, near, counts, able)
    return out


def find(docs: DataFrame, *, disclosure: float = 0.9, support: int = 20, entity_support: int = 5, bits_left: float = 0.25, literal_bytes: int = 1 << 20) -> DataFrame:
    """docs with columns in_email, in_ip, in_card, in_phone, in_term of spans; text null is empty.

    Revealing words of up to `literal_bytes` in all are part of the plan; more are a table that is joined by text.
    """
    rows = base_spans(docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    terms = revealing_terms(rows, disclosure=disclosure, support=support, entity_support=entity_support, bits_left=bits_left)
    held = terms.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term") + 16).alias("bytes")).first()
    if not held["n"]:
        return rows.withColumn("in_term", F.lit(None).cast(SPAN))
    if held["bytes"] <= literal_bytes:
        own = sorted(r["term"] for r in terms.collect())
        rows = rows.withColumn("any", _alternatives(F.array_distinct(F.filter(F.split(F.col("text"), NOT_LETTERS), lambda w: w.isin(own)))))
    else:
        rows = _joined_terms(rows, docs, terms)
    letters = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
    pattern = F.concat(F.lit(f"(?<!{letters})(?:"), F.col("any"), F.lit(f")(?!{letters})"))
    spans = F.when(F.col("any").isNotNull(), placed(F.col("text"), pattern, len(KINDS)))
    return rows.withColumn("in_term", spans).drop("any")


def _alternatives(words: Column) -> Column:
    return F.nullif(F.array_join(F.sort_array(words), "|"), F.lit(""))


def _joined_terms(rows: DataFrame, docs: DataFrame, terms: DataFrame, salts: int = 16) -> DataFrame:
    """rows with `any` by a join on the text's digest; copies of a text are dealt over `salts` keys."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    slim = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    each = slim.select(digest.alias("h"), F.explode(words_of(F.col("text"))).alias("term")).join(few(terms), "term")
    by_text = settle(each.groupBy("h").agg(_alternatives(F.collect_set("term")).alias("any")), "held")
    digested = rows.withColumn("h", digest)
    small = few(by_text)
    if small is not by_text:
        return digested.join(small, "h", "left").drop("h")
    own = row_key(rows)[0]
    spread = by_text.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return digested.withColumn("salt", F.pmod(own, F.lit(salts)).cast("int")).join(spread, ["h", "salt"], "left").drop("h", "salt")


def _all(kinds: tuple[str, ...]) -> Column:
    none = F.array().cast(SPAN)
    return F.array_sort(F.concat(*(F.coalesce(F.col(f"in_{k}"), none) for k in kinds)))


def _joined(spans: Column, names: tuple[str, ...]) -> Column:
    name = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, the number of base spans of each kind, their digest and all spans, for each row of docs."""
    found = find(docs.select("doc_id", "text"), **how)
    counts = [F.coalesce(F.size(f"in_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(_all(KINDS), KINDS).cast("binary"), 256).alias("base_sha256"),
        _joined(_all((*KINDS, "term")), (*KINDS, "term")).alias("spans"),
    )


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """docs with personal data replaced by labels: the union of all spans, overlapping ones as the first."""
    kinds = (*KINDS, "term")
    label = F.array(*(F.lit(LABELS[k]) for k in kinds))
    text = F.col("text")

    def clean(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        return _once(F.struct(blocks_of(text).alias("blocks"), ends.alias("ends")), partial(redrawn, spans))

    def redrawn(spans: Column, x: Column) -> Column:
        """The text up to each span that no earlier one reaches into, its label, and the rest."""

        def piece(s: Column, i: Column) -> Column:
            upto = F.coalesce(F.get(x["ends"], i - 1), F.lit(0))
            return F.when(s["start"] >= upto, F.concat(cut(x["blocks"], upto, s["start"] - upto), F.get(label, s["rank"]))).otherwise("")

        last = F.get(x["ends"], F.size(spans) - 1)
        return F.concat(F.array_join(F.transform(spans, piece), ""), cut(x["blocks"], last, F.length(text) - last))

    # the row travels as one column, so its other columns may have any names
    found = find(docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), **how).withColumn("all", _all(kinds))
    out = F.when(F.col("row.text").isNull(), F.lit(None)).when(F.size("all") > 0, _once(F.col("all"), clean)).otherwise(text)
    return found.select(F.col("row").withField("text", out).alias("row")).select("row.*")
