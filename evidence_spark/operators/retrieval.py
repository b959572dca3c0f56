"""Document retrieval: which texts can be searched, and their best snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from evidence_spark import policy
from evidence_spark.functions import text as tx
from evidence_spark.functions.scalars import contains_any
from evidence_spark.operators import feeds
from evidence_spark.session import scratch_table, sized

PARAGRAPH_BREAK = r"\n\s*\n|(?<=\.)\s{2,}"


def _count_literal(column: Column, literal: str) -> Column:
    return (F.length(column) - F.length(F.replace(column, F.lit(literal), F.lit("")))) / F.lit(len(literal))


def looks_like_raw_dump(clean: Column) -> Column:
    """Markup of an unextracted document instead of its text."""
    sample = clean
    marks = sum((_count_literal(sample, token) for token in policy.RAW_DUMP_TOKENS), F.lit(0.0))
    words = F.regexp_count(sample, F.lit(rf"(?i)\b({'|'.join(policy.READABLE_WORDS)})\b"))
    return sample.startswith("%PDF-") | ((marks >= 5) & (words < 3))


def indexable(df: DataFrame, text: str = "text", name: str = "text_available") -> DataFrame:
    """Add whether a text is readable prose: long enough, no raw dump, few single
    characters and enough different words, over the whole text."""
    prepared = df.withColumn("_clean", tx.clean_ws(F.col(text)))
    tokens = F.filter(F.split("_clean", r"\s+"), lambda t: t != "")
    words = F.regexp_extract_all("_clean", F.lit(r"([A-Za-z][A-Za-z-]{2,})"), F.lit(1))
    prepared = prepared.withColumns(
        {
            "_tokens": F.size(tokens),
            "_single": F.size(F.filter(tokens, lambda t: t.rlike("^[A-Za-z0-9]$"))),
            "_words": F.size(words),
            "_distinct": F.size(F.array_distinct(F.transform(words, lambda w: F.lower(w)))),
        }
    )
    c = F.col
    ok = (
        (F.length("_clean") >= 80) & ~looks_like_raw_dump(c("_clean")) & ~contains_any(c("_clean"), policy.PLACEHOLDER_TEXTS) & (c("_tokens") > 0)
        & (c("_single") / c("_tokens") <= 0.35) & (c("_words") >= 20) & (c("_distinct") >= 12)
    )
    return prepared.withColumn(name, F.coalesce(ok, F.lit(False))).drop("_clean", "_tokens", "_single", "_words", "_distinct")


def best_snippets(text: Column, keywords: Column, n: int = 3, max_chars: int | None = None) -> Column:
    """Best paragraphs of one text for one keyword list, as an array of (score, position,
    snippet). It needs no other row, so ranking a corpus is a single scan.

    Paragraphs of at least 80 characters count; a text without any is one paragraph. A
    keyword scores once when it occurs anywhere. Snippets are whole unless ``max_chars`` is given.
    """
    cleaned = F.transform(F.split(text, PARAGRAPH_BREAK), lambda p: tx.clean_ws(p))
    long_ones = F.filter(cleaned, lambda p: F.length(p) >= 80)
    chosen = F.when(F.size(long_ones) > 0, long_ones).otherwise(F.array(tx.clean_ws(text)))

    def rate(paragraph: Column, position: Column) -> Column:
        lower = F.lower(paragraph)
        matched = F.size(F.filter(keywords, lambda k: lower.contains(k)))
        bonus = F.when(lower.contains("information security"), 2).otherwise(0) + F.when(lower.contains("risk"), 1).otherwise(0)
        return F.struct((-(matched + bonus)).alias("order"), position.alias("position"), (paragraph if max_chars is None else F.substring(paragraph, 1, max_chars)).alias("snippet"))

    rated = F.filter(F.transform(chosen, rate), lambda r: r["order"] < 0)
    best = F.slice(F.sort_array(rated), 1, n)
    scored = F.transform(best, lambda r: F.struct((-r["order"]).alias("score"), r["position"].alias("position"), r["snippet"].alias("snippet")))
    return F.when(F.trim(text) != "", scored)


def rank_snippets(docs: DataFrame, question: str, n: int = 3) -> DataFrame:
    """Best snippets of every document for one question."""
    found = best_snippets(F.col("text"), tx.question_keywords(F.lit(question)), n)
    rows = docs.select("doc_id", F.posexplode(found).alias("_r", "s"))
    return rows.select("doc_id", (F.col("_r") + 1).alias("rank"), "s.score", "s.position", "s.snippet")


WORD = r"([a-z][a-z0-9_-]{2,})"


def words_with(vocabulary: DataFrame, keywords: DataFrame) -> DataFrame:
    """(keyword, word) for each keyword that a word of the vocabulary holds at any place.

    Both tables have one column ``word`` of distinct texts of three characters or more. A
    keyword meets the words under its rarest character trigram only; they are then compared
    whole. The vocabulary's trigrams are counted and then only those asked for are joined; they are
    never stored.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))
    index = vocabulary.filter(F.length("word") >= 3).select("word", F.explode(grams(F.col("word"))).alias("gram"))
    asked = keywords.filter(F.length("word") >= 3).select(F.col("word").alias("keyword"), F.explode(grams(F.col("word"))).alias("gram"))
    sizes = index.join(sized(asked.select("gram").distinct(), "grams"), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = asked.join(sized(sizes, "trigram-sizes"), "gram", "left").groupBy("keyword").agg(
        F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram")  # a trigram no word has finds nothing
    )
    return index.join(sized(rarest, "rarest"), "gram").filter(F.col("word").contains(F.col("keyword"))).select("keyword", "word")


def document_context(
    docs: DataFrame, questions: DataFrame, n: int | None = None, snippets: int = 3, excerpt_chars: int | None = None, inside: bool = False
) -> DataFrame:
    """Documents that hold a keyword of a question, with their snippets; for each question
    all of them, or the ``n`` newest.

    Keywords find documents through an inverted list of the searchable texts' words, so a
    question meets only documents it shares a word with, never all of them. A keyword is
    found as a whole word, with ``inside`` also within a longer one, as snippets score it.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(1)))
    ready = scratch_table(indexable(docs).filter("text_available").select("doc_id", "uploaded_at", "text", words.alias("_words")), "searchable")
    asked = scratch_table(questions.select("question_id", tx.question_keywords(F.col("question")).alias("_keys")), "asked")
    wanted = asked.select("question_id", F.explode("_keys").alias("word"))
    listed = ready.select("doc_id", "uploaded_at", F.explode("_words").alias("word"))
    if inside:
        vocabulary = scratch_table(listed.select("word").distinct(), "vocabulary")
        held = words_with(vocabulary, wanted.select("word").distinct())
        listed = listed.join(sized(held, "held"), "word").select("doc_id", "uploaded_at", F.col("keyword").alias("word"))
        if n is not None:
            # a document counts once however many of its words hold the keyword; ranked before they
            # are made distinct, as each task then sends on the newest of its own only
            of_word = Window.partitionBy("word").orderBy(F.desc("uploaded_at"), "doc_id")
            listed = listed.withColumn("_r", F.dense_rank().over(of_word)).filter(F.col("_r") <= n).drop("_r")
        listed = listed.distinct()
    else:
        listed = listed.join(wanted.select("word").distinct(), "word", "left_semi")
    if n is not None:
        # the newest n of each word hold the newest n of any question, so a common word meets no more
        of_word = Window.partitionBy("word").orderBy(F.desc("uploaded_at"), "doc_id")
        listed = listed.withColumn("_r", F.row_number().over(of_word)).filter(F.col("_r") <= n).drop("_r")
    met = listed.join(wanted, "word").select("question_id", "doc_id", "uploaded_at").distinct()
    if n is not None:
        newest = Window.partitionBy("question_id").orderBy(F.desc("uploaded_at"), "doc_id")
        met = met.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n)
    rows = sized(met.select("question_id", "doc_id"), "met").join(asked, "question_id").join(ready.select("doc_id", "text"), "doc_id")
    found = best_snippets(F.col("text"), F.col("_keys"), snippets)
    some = rows.withColumn("_found", F.coalesce(found, F.array().cast("array<struct<score:int,position:int,snippet:string>>")))
    excerpt = F.col("text") if excerpt_chars is None else F.substring("text", 1, excerpt_chars)
    return some.select(
        "question_id", "doc_id", F.size("_found").alias("snippets"), F.coalesce(F.get("_found", F.lit(0))["snippet"], excerpt).alias("shown"),
        F.when(F.size("_found") > 0, "relevant text found").otherwise("no text matched").alias("note"),
    )


def unreadable_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, uploaded_at, note) of the documents that ``document_context`` cannot search:
    one row for each, whatever the questions, as any of them could have used it."""
    note = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text").otherwise("text is not readable")
    return indexable(docs).filter(~F.col("text_available")).select("doc_id", "uploaded_at", note.alias("note"))


def question_context(questions: DataFrame, pool: DataFrame, per_question: int | None = None, top: int = 10) -> DataFrame:
    """Records per question, with ``requested``: the pool's records of the sequences named in
    the text; a question for which none is found, or that names none, gets the ``top`` records
    of the pool instead (a fixed page, the same for all such questions)."""
    asked = _named(questions)
    found = pool.join(asked, "sequence")
    if per_question is not None:
        order = Window.partitionBy("question_id").orderBy("sequence", "evidence_id")
        found = found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_question).drop("_r")
    met = pool.select("sequence").join(asked, "sequence").select("question_id")
    others = questions.select("question_id").distinct().join(met, "question_id", "left_anti")
    first = feeds.top_evidence(pool, top).crossJoin(others)
    return found.withColumn("requested", F.lit(True)).unionByName(first.withColumn("requested", F.lit(False)))


def _named(questions: DataFrame) -> DataFrame:
    """(question_id, sequence) of all numbers that the questions name."""
    named = questions.select("question_id", F.explode(tx.extract_sequences(F.col("question"))).alias("_s"))
    return named.select("question_id", F.col("_s").try_cast("bigint").alias("sequence")).filter("sequence IS NOT NULL").distinct()


def question_edges(questions: DataFrame, context: DataFrame, nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """Edges per question that touch the event nodes of the sequences it names and of the
    records in its ``context``; a question that meets no node gets those of the ``top`` events
    by risk. An event node belongs to the sequence that ends its id."""
    wanted = _named(questions).unionByName(context.select("question_id", "sequence")).distinct()
    events = nodes.filter("kind = 'event'")
    numbered = events.select("id", F.regexp_extract("id", r"([0-9]+)$", 1).try_cast("bigint").alias("sequence"))
    met = scratch_table(numbered.join(wanted, "sequence").select("question_id", "id").distinct(), "question-nodes")
    others = questions.select("question_id").distinct().join(met, "question_id", "left_anti")
    met = met.unionByName(others.crossJoin(events.orderBy(F.desc("risk"), "id").limit(top).select("id")))
    out = edges.join(met.withColumnRenamed("id", "source"), "source")
    into = edges.join(met.withColumnRenamed("id", "target"), "target")
    return out.unionByName(into).distinct()
