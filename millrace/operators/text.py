"""Chunking, normalisation, aliases and link extraction."""

from __future__ import annotations

import html
import re
import unicodedata
import urllib.parse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.model import MillraceError
from millrace.session import numbered

#: Sentence ends: Latin and East Asian full stops, exclamation and question marks.
SENTENCE_ENDS = ".!?。！？"
CHUNK = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise MillraceError("chunks need size > 0 and 0 <= overlap < size")


def _boundary(text: str, start: int, stop: int, overlap: int) -> int:
    """Where a chunk that may reach stop ends: after the last sentence end, else at the last blank, else at stop."""
    blank = None
    for i in range(stop, start + overlap, -1):
        before = text[i - 1]
        if before in SENTENCE_ENDS and (i == len(text) or i == stop or text[i].isspace()):
            return i
        if blank is None and before.isspace():
            blank = i
    return blank if blank is not None else stop


def chunk_text(text: str | None, size: int, overlap: int = 0, sentences: bool = False) -> list[tuple[int, str, int, int]]:
    """(ordinal, text, start byte, end byte): chunks of at most size characters, blanks at their ends trimmed, blank ones left out."""
    _check(size, overlap)
    out, start, text = [], 0, text or ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upto = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
    while start < len(text):
        stop = min(len(text), start + size)
        if sentences and stop < len(text):
            stop = _boundary(text, start, stop, overlap)
        piece = text[start:stop]
        a = start + len(piece) - len(piece.lstrip())
        b = start + len(piece.rstrip())
        if a < b:
            out.append((len(out), text[a:b], int(upto[a]), int(upto[b])))
        if stop >= len(text):
            break
        start = max(stop - overlap, start + 1)
    return out


def chunker(size: int, overlap: int = 0, sentences: bool = False):
    """A column function: text to an array of chunks."""
    _check(size, overlap)

    @F.pandas_udf(T.ArrayType(CHUNK))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("ordinal", "text", "start", "end"), c)) for c in chunk_text(t, size, overlap, sentences)])

    return run


def chunks(docs: DataFrame, size: int, overlap: int = 0, sentences: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    made = docs.select(F.col(id_col), F.explode(chunker(size, overlap, sentences)(F.col(text_col))).alias("c"))
    return made.select(id_col, F.col("c.ordinal").alias("ordinal"), F.col("c.text").alias("text"), F.col("c.start").alias("start"), F.col("c.end").alias("end"))


def within_tokens(text: str, most: int, count) -> list[str]:
    """Halves a text until count, the caller's, finds at most `most` tokens in each part; single characters stay."""
    if count(text) <= most or len(text) <= 1:
        return [text] if text.strip() else []
    middle = len(text) // 2
    cut = max(text.rfind(" ", 0, middle), 0) or middle
    return within_tokens(text[:cut], most, count) + within_tokens(text[cut:], most, count)


def invalid_chunks(made: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks that are empty, out of range or no exact slice of their document's bytes."""
    j = made.alias("m").join(docs.select(F.col(id_col), F.col(text_col).alias("_whole")), id_col, "left")
    cut = F.expr("substring(cast(_whole as binary), cast(start + 1 as int), cast(end - start as int))")
    ok = (F.length("text") > 0) & (F.col("start") >= 0) & (F.col("end") <= F.octet_length("_whole")) & (F.col("start") < F.col("end")) & (cut == F.col("text").cast("binary"))
    return j.filter(~F.coalesce(ok, F.lit(False))).select(id_col, "ordinal")


def sections(text: Column, chars_per_token: int = 4) -> Column:
    """Sections of a text at blank lines, each with its token estimate."""
    parts = F.filter(F.transform(F.split(text, r"\n[ \t]*\n"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    return F.transform(parts, lambda s: F.struct(s.alias("text"), F.floor(F.length(s) / chars_per_token).alias("tokens")))


def section_chunks(docs: DataFrame, token_limit: int = 400, overlap: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ordinal, text: whole sections together up to a token estimate, each chunk beginning with the last `overlap` sections of the one before.

    A text within the limit is one chunk. Sections are parted by blank lines, or
    else by lines, or else by sentences, which keep their mark and are joined by
    one more. A section beyond the limit stays whole. Null texts give no chunks.
    """
    t = F.col(text_col)
    mark = F.when(F.contains(t, F.lit("\n\n")), "\n\n").when(F.contains(t, F.lit("\n")), "\n").otherwise(". ")
    raw = F.when(mark == "\n\n", F.split(t, "\n\n", -1)).when(mark == "\n", F.split(t, "\n", -1)).otherwise(F.split(t, r"\. ", -1))
    parts = F.when(mark == ". ", F.transform(raw, lambda s, i: F.when(i < F.size(raw) - 1, F.concat(s, F.lit(". "))).otherwise(s))).otherwise(raw)
    estimate = lambda s: F.floor(F.length(s) / 4)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, s: n + estimate(s))
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("open"), F.lit(0).cast("long").alias("tokens"))

    def step(state, section):
        full = (state["tokens"] + estimate(section) > token_limit) & (F.size(state["open"]) > 0)
        kept = F.slice(state["open"], F.greatest(F.lit(1), F.size(state["open"]) - overlap + 1), F.lit(overlap)) if overlap else empty
        opened = F.when(full, kept).otherwise(state["open"])
        done = F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.concat(opened, F.array(section)).alias("open"), (F.when(full, total(kept)).otherwise(state["tokens"]) + estimate(section)).alias("tokens"))

    grouped = F.aggregate(parts, start, step, lambda s: F.concat(s["done"], F.array(s["open"])))
    chunks = F.when(estimate(t) <= token_limit, F.array(t)).otherwise(F.transform(grouped, lambda g: F.when(mark == "\n\n", F.array_join(g, "\n\n")).when(mark == "\n", F.array_join(g, "\n")).otherwise(F.array_join(g, ". "))))
    return docs.filter(t.isNotNull()).select(F.col(id_col), F.posexplode(chunks).alias("ordinal", "text"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def normalise_text(text: str | None) -> str:
    """NFC, full case folding, blanks squeezed."""
    return " ".join(unicodedata.normalize("NFC", text or "").casefold().split())


def lowered_text(text: str) -> str:
    """Lower case, letter by letter and of the same length, as SQL has it: no folding of sharp s."""
    return "".join(c.lower()[0] for c in text)


@F.pandas_udf(T.StringType())
def lowered(texts: pd.Series) -> pd.Series:
    return texts.map(lowered_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def normalised(texts: pd.Series) -> pd.Series:
    return texts.map(normalise_text)


def alias_spans(question: str, aliases: list[str]) -> list[tuple[str, int, int]]:
    """(alias, start, end) of normalised aliases in a normalised question, with no letter or digit beside them."""
    out = []
    for a in aliases:
        at = question.find(a)
        while a and at >= 0:
            end = at + len(a)
            if (at == 0 or not question[at - 1].isalnum()) and (end == len(question) or not question[end].isalnum()):
                out.append((a, at, end))
            at = question.find(a, at + 1)
    return out


def alias_spans_original(text: str, aliases: list[str]) -> list[tuple[str, int, int]]:
    """alias_spans with offsets into the text as written: the characters whose normal form an alias covers."""
    plain, at = [], []  # normalised characters, and the place each came from
    i = 0
    while i < len(text):
        end = i + 1
        while end < len(text) and unicodedata.combining(text[end]):
            end += 1
        for c in unicodedata.normalize("NFC", text[i:end]).casefold():
            if c.isspace():
                if plain and plain[-1] != " ":
                    plain.append(" ")
                    at.append((i, end))
            else:
                plain.append(c)
                at.append((i, end))
        i = end
    return [(a, at[lo][0], at[hi - 1][1]) for a, lo, hi in alias_spans("".join(plain), aliases)]


def boundary_substrings(question: str, most_words: int | None = None) -> list[str]:
    """All runs of words of a normalised question, of up to most_words if given, punctuation at their ends taken off."""
    return sorted(x for x in _runs(question.split(), most_words) if x)


def _runs(words: list[str], most_words: int | None) -> set[str]:
    longest = most_words or len(words)
    return {" ".join(words[i:j]).strip(".,;:!?\"'()") for i in range(len(words)) for j in range(i + 1, min(len(words), i + longest) + 1)}


def question_parts(texts: Column, most_words: int, portable: bool = False) -> Column:
    """Runs of words of each question in its normal form; portable: as SQL reads them, in lower case between ASCII blanks, words of punctuation as empty ones."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def parts(batch: pd.Series) -> pd.Series:
        if portable:
            return batch.map(lambda t: sorted(_runs(re.split(r"[\t\n\f\r ]+", lowered_text(t).strip(" ")), most_words)) if t is not None else [])
        return batch.map(lambda t: boundary_substrings(normalise_text(t), most_words))

    return parts(texts)


def resolve_seeds(questions: DataFrame, aliases: DataFrame, portable: bool = False) -> DataFrame:
    """question_id, status (resolved, ambiguous, no_match), seed: the longest alias found decides.

    questions: question_id, text. aliases: alias (normalised, or lowered if portable), node. Parts of a
    question, as long as the longest alias, meet aliases in an equi-join, so no
    question is held against every alias.
    """
    most = aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    parts = questions.select("question_id", F.explode(question_parts(F.col("text"), most, portable)).alias("alias"))
    hits = parts.join(aliases.distinct(), "alias")
    longest = hits.groupBy("question_id").agg(F.max(F.length("alias")).alias("_l"))
    top = hits.join(longest, "question_id").filter(F.length("alias") == F.col("_l")).groupBy("question_id").agg(F.countDistinct("node").alias("_n"), F.min("node").alias("seed"))
    j = questions.select("question_id").join(top, "question_id", "left")
    status = F.when(F.col("_n").isNull(), "no_match").when(F.col("_n") > 1, "ambiguous").otherwise("resolved")
    return j.select("question_id", status.alias("status"), F.when(F.col("_n") == 1, F.col("seed")).alias("seed"))


HREF = r'href="([^"]*)"'


def link_aliases(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Distinct targets of a page's links: URL-decoded, HTML-unescaped, normalised."""

    @F.pandas_udf(T.StringType())
    def clean(links: pd.Series) -> pd.Series:
        return links.map(lambda x: normalise_text(html.unescape(urllib.parse.unquote(x))))

    links = pages.select(id_col, F.explode(F.regexp_extract_all(html_col, F.lit(HREF), F.lit(1))).alias("href"))
    return links.select(id_col, clean("href").alias("alias")).filter("alias <> ''").distinct()


def hash_sample(rows: DataFrame, key: str, salt: str, n: int) -> DataFrame:
    """The n rows whose salted SHA-256 comes first: the same for any order and partitioning."""
    return rows.withColumn("_h", F.sha2(F.concat(F.lit(salt + ":"), F.col(key).cast("string")), 256)).orderBy("_h", key).limit(n).drop("_h")


def clean_metadata(fields: Column) -> Column:
    """A string map without nulls and empty values."""
    return F.map_filter(fields, lambda k, v: v.isNotNull() & (v != ""))


def query_text(text: Column, most: int = 160) -> Column:
    """Blanks squeezed; beyond `most` characters cut at the last blank."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.substring(flat, 1, most)
    return F.when(F.length(flat) <= most, flat).otherwise(F.when(F.instr(cut, " ") > 0, F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut))


def distinct_cycled(questions: DataFrame, order: str, question: str, wanted: int) -> DataFrame:
    """place, question: distinct questions in the order of their first appearance, repeated in turn up to `wanted`."""
    first = questions.filter(F.col(question) != "").groupBy(question).agg(F.min(order).alias("_o"))
    listed = numbered(first, ["_o"], 0, "_i")
    n = listed.count()
    if not n:
        return questions.sparkSession.createDataFrame([], "place long, question string")
    turns = F.explode(F.sequence(F.lit(0), F.lit(-(-wanted // n) - 1)))
    places = listed.select(F.col(question).alias("question"), "_i", turns.alias("_t")).select((F.col("_t") * n + F.col("_i")).cast("long").alias("place"), "question")
    return places.filter(F.col("place") < wanted)


def freeze(primary: DataFrame, pages: DataFrame, title: str, page: str) -> DataFrame:
    """One page per wanted title; among several the least id."""
    return primary.select(title).distinct().join(pages.groupBy(title).agg(F.min(page).alias(page)), title)


class WordPiece:
    """Greedy longest-match pieces of lower-cased, accent-stripped words, with the counts a text encoder sees."""

    def __init__(self, vocabulary: list[str], unknown: str = "[UNK]", most: int = 256):
        self.index = {w: i for i, w in enumerate(vocabulary)}
        self.unknown, self.most = unknown, most

    def words(self, text: str) -> list[str]:
        out, word = [], ""
        plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
        for c in plain:
            single = not c.isalnum() or "一" <= c <= "鿿"
            if c.isspace() or single:
                if word:
                    out.append(word)
                word = ""
                if single and not c.isspace() and unicodedata.category(c)[0] != "C":
                    out.append(c)
            else:
                word += c
        return out + ([word] if word else [])

    def pieces(self, text: str) -> list[str]:
        out = []
        for word in self.words(text):
            at, found = 0, []
            while at < len(word):
                end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in self.index), None)
                if end is None:
                    found = [self.unknown]
                    break
                found.append(("##" if at else "") + word[at:end])
                at = end
            out += found
        return out[: self.most - 2]

    def encode(self, text: str, start: str = "[CLS]", end: str = "[SEP]", pad: str | None = "[PAD]") -> tuple[list[int], list[int]]:
        """Numbers of the pieces between start and end marks, cut at `most`, and the mask of those that count; padded to `most` unless pad is None."""
        ids = [self.index[start], *(self.index[p] for p in self.pieces(text)), self.index[end]]
        rest = self.most - len(ids) if pad is not None else 0
        return ids + [self.index[pad]] * rest if rest else ids, [1] * len(ids) + [0] * rest

    def count(self, text: str) -> int:
        return len(self.pieces(text)) + 2


def lookup_embeddings(texts: DataFrame, known: DataFrame) -> DataFrame:
    """text with its precomputed embedding; a text without one is an error."""
    j = texts.join(known.dropDuplicates(["text"]), "text", "left")
    lost = j.filter("embedding IS NULL").select("text").limit(1).collect()
    if lost:
        raise MillraceError(f"no embedding for {lost[0][0]!r}")
    return j


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the hidden states (texts, places, width) over the places that count, as unit vectors; texts without any give zeros."""
    weight = mask[..., None].astype(np.float32)
    mean = (hidden * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)
    size = np.linalg.norm(mean, axis=1, keepdims=True)
    return mean / np.where(size > 0, size, 1.0)


def encoder(pieces: WordPiece, run):
    """A provider for embed: texts to unit vectors, where run maps (ids, mask) to hidden states, as a session of a sentence encoder does."""

    def provide(texts: list[str]) -> list[list[float]]:
        rows = [pieces.encode(t) for t in texts]
        ids, mask = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        return pooled(run(ids, mask), mask).tolist() if rows else []

    return provide


def embed(docs: DataFrame, provider, text_col: str = "text") -> DataFrame:
    """docs with an embedding column; provider maps a list of texts to a list of vectors, a batch at a time."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(embedding=[list(map(float, v)) for v in provider(pdf[text_col].tolist())])

    schema = T.StructType([*docs.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return docs.mapInPandas(run, schema)
