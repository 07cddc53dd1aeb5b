"""The positional index of documents: postings (id, col, off, term), documents with their lengths, vocabulary, statistics.

Documents: space, doc_id (string), id (long, in the order of writing), updated (nanoseconds), title, txt, alive. Documents that aren't
alive have empty title and text, and count among all documents.

A saved index holds postings in blocks sorted by term (operators/blocks.py), so a search reads the row groups of its terms only. A posting repeats what a
search needs to know of its document (length, space, alive), so matching and ranking read and shuffle postings alone.
Documents and texts are sorted by id and read for the ids of the page that is shown. The numbers of all documents are kept beside them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import stemming, text
from quernstone.operators import blocks
from quernstone.session import cut, delete

TITLE, BODY = 0, 1
#: Terms that are broadcast at most; more are joined by a shuffle.
BROADCAST_TERMS = 100_000


@dataclass(frozen=True)
class Analyser:
    """How texts become terms; kept with an index, and compared when it is opened."""

    languages: tuple[str, ...] = ()
    diacritics: bool = False  # whether they are removed
    token_chars: str = ""
    separators: str = ""
    least_bytes: int = 2

    @property
    def settings(self) -> tuple[str, str, int]:
        """What the functions of functions.text take after a text."""
        return self.token_chars, self.separators, self.least_bytes

    def tokens_of(self, phrase: str) -> list[str]:
        """Tokens of a phrase, on the driver, neither folded nor stemmed."""
        return text.words_of(phrase, *self.settings)

    def words(self, phrase: str) -> list[str]:
        """Terms of a phrase, on the driver."""
        found = self.tokens_of(phrase)
        found = [text.fold(w) for w in found] if self.diacritics else found
        return [stemming.stem(w, self.languages) for w in found] if self.languages else found

    def tokens(self, c: Column) -> Column:
        return text.tokens(c, *self.settings)

    def finisher(self) -> blocks.Finish | None:
        """What finish() does, for a list of terms on a worker."""
        if not self.diacritics and not self.languages:
            return None
        chain = tuple((n, stemming.STEMMERS[n]) for n in self.languages)

        def run(terms: list[str]) -> list[str]:
            for n, f in chain:
                stemming.STEMMERS.setdefault(n, f)
            found = [text.fold(t) for t in terms] if self.diacritics else terms
            return [stemming.stem(t, self.languages) for t in found] if self.languages else found

        return run

    def finish(self, rows: DataFrame) -> DataFrame:
        """Folds and stems the terms of rows; each distinct term once."""
        if not self.diacritics and not self.languages:
            return rows
        term = text.fold_of("term") if self.diacritics else F.col("term")
        term = stemming.stem_of(term, self.languages) if self.languages else term
        made = rows.select("term").distinct().select("term", term.alias("__to"))
        return rows.join(made, "term").withColumn("term", F.col("__to")).select(*rows.columns)


def deleted_cleared(docs: DataFrame) -> DataFrame:
    """Documents that aren't alive lose their title and text."""
    return docs.withColumns({c: F.when(F.col("alive"), F.coalesce(F.col(c), F.lit(""))).otherwise("") for c in ("title", "txt")})


@dataclass
class Index:
    docs: DataFrame  # id, space, doc_id, updated, alive, title, n_tokens, n_title, n_body
    postings: DataFrame  # id, col, off, term, n_tokens, space, alive
    texts: DataFrame  # id, txt
    analyser: Analyser = field(default_factory=Analyser)
    kept_totals: tuple[int, float] | None = None
    kept_vocabulary: DataFrame | None = None  # term, doc, cnt, sorted by term
    tokenised: DataFrame | None = None  # the documents with their tokens (tt, tb), of which an index that isn't saved is a plan
    kept_blocks: DataFrame | None = None  # of a saved index, what postings are read from

    @staticmethod
    def of(docs: DataFrame, analyser: Analyser | None = None) -> Index:
        """An index as a plan over documents."""
        analyser = analyser or Analyser()
        docs = deleted_cleared(docs)
        return Index._of(docs.withColumns({"tt": analyser.tokens(F.col("title")), "tb": analyser.tokens(F.col("txt"))}), docs.select("id", "txt"), analyser)

    @staticmethod
    def _of(docs: DataFrame, texts: DataFrame, analyser: Analyser) -> Index:
        sized = docs.select("id", "space", "doc_id", "updated", "alive", "title", F.size("tt").alias("n_title"), F.size("tb").alias("n_body"))
        sides = F.array(*(F.struct(F.lit(k).alias("col"), F.col(c).alias("terms")) for k, c in ((TITLE, "tt"), (BODY, "tb"))))
        own = F.struct((F.col("n_title") + F.col("n_body")).alias("n_tokens"), "space", "alive").alias("d")
        counted = docs.withColumns({"n_title": F.size("tt"), "n_body": F.size("tb")})
        each = counted.select("id", own, F.explode(sides).alias("s")).select("id", F.col("s.col").alias("col"), F.posexplode("s.terms").alias("off", "term"), "d.n_tokens", "d.space", "d.alive")
        return Index(sized.withColumn("n_tokens", F.col("n_title") + F.col("n_body")), analyser.finish(each), texts, analyser, tokenised=docs)

    def save(self, path: str, partitions: int | None = None) -> Index:
        """Writes the index. Texts are cut into tokens once: these are written down, and all parts are made from there."""
        spark = self.docs.sparkSession
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        source = self
        if self.tokenised is not None:
            self.tokenised.select("id", "space", "doc_id", "updated", "alive", "title", "tt", "tb").write.mode("overwrite").parquet(f"{path}/tokens")
            source = Index._of(spark.read.parquet(f"{path}/tokens"), self.texts, self.analyser)
        source.docs.repartitionByRange(n, "id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/docs")
        n_tokens = spark.read.parquet(f"{path}/docs").agg(F.sum("n_tokens")).first()[0] or 0
        n = max(n, -(-n_tokens // blocks.RANGE_TOKENS))  # so that what one task sorts doesn't grow with the documents
        source.texts.repartitionByRange(n, "id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/texts")
        if source is not self:
            blocks.write(source.tokenised, self.analyser.finisher(), n_tokens, n, f"{path}/postings")
            delete(spark, f"{path}/tokens")
        else:
            blocks.of_rows(self.postings).repartitionByRange(n, "term", "ids").sortWithinPartitions("term", "ids").write.mode("overwrite").parquet(f"{path}/postings")
        write_state(spark, path, self.analyser)
        made = Index.open(spark, path, self.analyser)
        vocabulary = made.vocabulary()
        vocabulary.repartitionByRange(n, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/vocabulary")
        made.kept_vocabulary = spark.read.parquet(f"{path}/vocabulary")
        spark.createDataFrame([made.totals()], "n_docs long, avgdl double").coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
        return made

    @staticmethod
    def open(spark: SparkSession, path: str, analyser: Analyser | None = None, force: bool = False) -> Index:
        """Refuses an index that was made by another analyser, unless forced (which writes the new one down)."""
        kept = read_state(spark, path)
        if analyser and kept and analyser != kept:
            if not force:
                raise ValueError(f"the index was made with {kept}, not {analyser}")
            write_state(spark, path, analyser)
        docs, postings, texts = (spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "texts"))
        made = Index(docs, postings, texts, analyser or kept or Analyser())
        if "ids" in postings.columns:  # else a row for each occurrence, as earlier versions saved them
            made.postings, made.kept_blocks = blocks.rows_of(postings), postings
        try:
            totals = tuple(spark.read.parquet(f"{path}/totals").first())
            made.kept_vocabulary, made.kept_totals = spark.read.parquet(f"{path}/vocabulary"), totals
        except AnalysisException:  # it is only being saved
            pass
        return made

    def totals(self) -> tuple[int, float]:
        """Number of documents and their mean length; counted once."""
        if self.kept_totals is None:
            n, mean = self.docs.agg(F.count("*"), F.avg("n_tokens")).first()
            self.kept_totals = (n, mean or 0.0)
        return self.kept_totals

    # Vocabulary

    def vocabulary(self) -> DataFrame:
        """term, doc (documents with it), cnt (occurrences). A saved index has it ready."""
        if self.kept_vocabulary is not None:
            return self.kept_vocabulary
        if self.kept_blocks is not None:
            return self.kept_blocks.groupBy("term").agg(F.sum("doc").alias("doc"), F.sum("cnt").alias("cnt"))
        per_doc = self.postings.groupBy("term", "id").agg(F.count("*").alias("n"))
        return per_doc.groupBy("term").agg(F.count("*").alias("doc"), F.sum("n").alias("cnt"))

    def stats(self) -> DataFrame:
        """One row: n_docs, n_alive, total_terms, unique_terms, avgdl."""
        docs = self.docs.agg(F.count("*").alias("n_docs"), F.count_if("alive").alias("n_alive"), F.sum("n_tokens").cast("long").alias("total_terms"), F.avg("n_tokens").alias("avgdl"))
        return docs.withColumn("unique_terms", self.vocabulary().select(F.count("*")).scalar())

    def per_space(self) -> DataFrame:
        return self.docs.groupBy("space").agg(F.count("*").alias("n_docs"), F.count_if("alive").alias("n_alive"), F.max("updated").alias("last_update"))

    def top_terms(self, n: int = 15) -> DataFrame:
        return self.vocabulary().orderBy(F.desc("cnt"), "term").limit(n)

    def check(self) -> DataFrame:
        """Postings that are missing (side = missing) or too many (side = extra) against the texts: empty for a sound index. Occurrences are first
        compared by a number and two digests for each term, added up before they are shuffled; those of terms that differ are then compared one by one."""
        columns = ["id", "col", "off", "term"]
        fresh, kept = self._fresh().select(*columns), self.postings.select(*columns)
        digest = F.xxhash64(*columns)
        signed = [rows.select("term", F.lit(n).alias("n"), digest.alias("x"), (F.shiftright(digest, 36) * n).alias("s")) for rows, n in ((fresh, 1), (kept, -1))]
        sums = signed[0].unionByName(signed[1]).groupBy("term").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))
        differ = cut(sums.where("n <> 0 or x <> 0 or s <> 0").select("term"))
        some = F.broadcast(differ) if differ.count() <= BROADCAST_TERMS else differ
        fresh, kept = (rows.join(some, "term", "left_semi").select(*columns) for rows in (fresh, kept))
        return fresh.exceptAll(kept).withColumn("side", F.lit("missing")).unionByName(kept.exceptAll(fresh).withColumn("side", F.lit("extra")))

    def _fresh(self) -> DataFrame:
        """Occurrences by the texts. Where each document has one text, and the deleted have an empty one, texts needn't meet their documents."""
        docs = self.docs.select("id", F.lit(1).alias("d"), F.lit(0).alias("t"), (~F.col("alive")).cast("int").alias("bad"))
        texts = self.texts.select("id", F.lit(0).alias("d"), F.lit(1).alias("t"), (F.coalesce(F.octet_length("txt"), F.lit(0)) > 0).cast("int").alias("bad"))
        both = docs.unionByName(texts).groupBy("id").agg(F.sum("d").alias("d"), F.sum("t").alias("t"), F.sum("bad").alias("bad"))
        if not both.where("d <> 1 or t <> 1 or bad > 1").isEmpty():
            return self.rebuild().postings
        title = F.when(F.col("alive"), F.coalesce("title", F.lit(""))).otherwise("")
        sides = [(TITLE, self.docs.select("id", title.alias("x"))), (BODY, self.texts.select("id", F.coalesce("txt", F.lit("")).alias("x")))]
        each = [rows.select("id", F.lit(k).alias("col"), F.posexplode(self.analyser.tokens(F.col("x"))).alias("off", "term")) for k, rows in sides]
        return self.analyser.finish(each[0].unionByName(each[1]))

    def rebuild(self) -> Index:
        return Index.of(self.docs.join(self.texts, "id"), self.analyser)


def write_state(spark: SparkSession, path: str, analyser: Analyser) -> None:
    spark.createDataFrame([(json.dumps(vars(analyser)),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/analyser")


def read_state(spark: SparkSession, path: str) -> Analyser | None:
    try:
        rows = spark.read.text(f"{path}/analyser").collect()
    except AnalysisException:  # an index that is only begun has none
        return None
    kept = json.loads(rows[0][0])
    return Analyser(**kept | {"languages": tuple(kept["languages"])})


def stopwords(vocabulary: DataFrame, cutoff: float = 0.01, most: int = 15, user: DataFrame | None = None) -> DataFrame:
    """Terms with more than `cutoff` of all occurrences, the `most` frequent of them; words that the user listed are left out."""
    total = vocabulary.agg(F.sum("cnt")).scalar()
    found = vocabulary.where(F.col("cnt") > total * F.lit(cutoff))
    if user is not None:
        found = found.join(user.select(F.col("word").alias("term")), "term", "left_anti")
    return found.orderBy(F.desc("cnt"), "term").limit(most).select(F.col("term").alias("word"), "cnt")
