"""The knowledge base as a whole: ingest files, rebuild the index, retrieve, report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import segment, text as X
from ..operators import blocks as B, bm25, chunks, dense, quality, ranking, vector_index
from ..sources import discovery, formats, pdf
from ..sources.store import Store
from . import prompts
from .config import Settings
from .models import Chat, Embedder, HashedEmbedder, embedded


def numbered(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.xxhash64("child_id").alias("vec_id"), "child_id", "embedding", "metadata")


class KnowledgeBase:
    """A log of documents, chunks, vectors and the lexical index in one folder."""

    def __init__(self, spark: SparkSession, folder: str, s: Settings | None = None, make_embedder=HashedEmbedder):
        self.spark, self.s, self.make_embedder = spark, s or Settings(), make_embedder
        self.folder, self.store = folder.rstrip("/"), Store(spark, folder)

    # --- ingest ---

    def _staged(self, stage: str, name: str, rows: DataFrame) -> DataFrame:
        """Rows written to the batch's staging folder and read again: each step of an ingest runs once."""
        path = f"{self.folder}/staging/{stage}/{name}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _unstage(self, stage: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/staging/{stage}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def parsed(self, files: DataFrame, stage: str, papers: DataFrame | None = None) -> dict[str, DataFrame]:
        """Tables of files (path, file_type, content_hash, content), staged; papers are PDF files with their sidecars' texts.

        Files that can't be read are rows of the table `failures`, and in no other.
        """
        s, now = self.s, F.current_timestamp()
        texts = self._staged(stage, "texts", formats.read_texts(files))
        failures = texts.select("path", "file_type", "content_hash", "error")
        docs = formats.documents(texts)
        blocks, references, by_path = formats.document_blocks(docs), None, None
        if papers is not None:
            papers = self._staged(stage, "papers", papers)
            failures = failures.unionByName(papers.select(failures.columns))
            papers = self._staged(stage, "paper-documents", formats.pdf_documents(papers))
            blocks = blocks.unionByName(formats.pdf_blocks(papers), allowMissingColumns=True).unionByName(pdf.blocks(papers.where("pages is not null")), allowMissingColumns=True)
            references, by_path = formats.tei_references(papers), papers.where("tei is not null").select("doc_id")
            docs = docs.unionByName(papers.drop("layout", "tei", "pages"), allowMissingColumns=True)
        docs = formats.titles(docs, blocks)
        if s.enable_cleaning:
            blocks = B.annotate(blocks, s.repeated_headers, s.repeated_header_min_pages, s.exclude_references)
        blocks = self._staged(stage, "blocks", blocks)
        heads = docs.select("doc_id", "title", F.col("path").alias("source_path"), "source_type", "file_type")
        size = {"most": s.parent_chunk_max_tokens, "least": s.parent_chunk_min_tokens, "cleaning": s.enable_cleaning}
        if by_path is None:
            parents, assets = chunks.parents(blocks, heads, **size)
        else:  # sections of a TEI come as paths, others by headings
            parents, assets = chunks.parents(blocks.join(by_path, "doc_id", "left_anti"), heads, **size)
            more, also = chunks.parents(blocks.join(by_path, "doc_id", "left_semi"), heads, by_path=True, **size)
            parents, assets = parents.unionByName(more), assets.unionByName(also)
        parents = self._staged(stage, "parents", parents)
        kids = self._staged(stage, "children", chunks.children(parents, s.child_chunk_size, s.child_chunk_overlap))
        vectors = kids.select("child_id", F.col("embedding_text").alias("document"), embedded(F.col("embedding_text"), self.make_embedder).alias("embedding"))
        failures = failures.where("error is not null").select("path", "file_type", "content_hash", "error.reason", "error.message", now.alias("failed_at"))
        tables = {"documents": docs.withColumn("source_path", F.col("path")), "parent_chunks": parents, "child_chunks": kids, "assets": assets, "child_vectors": vectors, "failures": failures}
        if references is not None:
            tables["references"] = references
        return {n: self._shaped(n, t.withColumns({c: now for c in ("created_at", "updated_at") if c not in t.columns})) for n, t in tables.items()} | {"blocks": blocks, "pieces": kids}

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        from ..sources.store import SCHEMAS

        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))

    def ingest(self, folders: list[str], include: list[str] | None = None, exclude: list[str] | None = None, recursive: bool = True, dry_run: bool = False, reset: bool = False, skip_quality_failures: bool = False) -> dict:
        """Ingests new and changed files of folders as one version of the store: statuses, counters and warnings.

        A file that can't be read has the status `failed:<reason>` and a row in the table `failures` until it can; what
        the store has of it stays. The others are ingested.
        """
        found = discovery.candidates(discovery.files(self.spark, folders, recursive), include, exclude)
        statuses = {f"{r.status}:{r.reason}" if r.reason else r.status: r["count"] for r in found.groupBy("status", "reason").count().collect()}
        # a reset takes effect with the new version: until then, and if this fails, the old one stays
        known = (self.store.table("documents").where("false") if reset else self.store.table("documents")).select(F.col("source_path").alias("path"), "content_hash")
        todo = discovery.ingest_status(found.where("status = 'pending'").select("path", "content_hash"), known)
        stage = uuid.uuid4().hex
        try:
            todo = self._staged(stage, "todo", todo)
            wanted = todo.where("status in ('new', 'changed')")
            if not wanted.take(1):
                if reset and not dry_run:
                    self.store.reset()
                return {"statuses": statuses | {r.status: r["count"] for r in todo.groupBy("status").count().collect()}, "counters": {}, "warnings": []}
            is_pdf = F.lower("path").endswith(".pdf")
            papers = self._papers(wanted.where(is_pdf), found, folders, stage) if wanted.where(is_pdf).take(1) else None
            made = self.parsed(formats.typed(formats.contents(self.spark, folders, wanted.where(~is_pdf))), stage, papers)
            blocks, pieces = made.pop("blocks"), made.pop("pieces")
            ends = todo.join(made["failures"].select("path", "reason"), "path", "left")
            ends = ends.groupBy(F.coalesce(F.concat(F.lit("failed:"), "reason"), "status").alias("status")).count()
            statuses |= {r.status: r["count"] for r in ends.collect()}
            stats = self._staged(stage, "stats", quality.document_stats(made["documents"], made["parent_chunks"], pieces, made["assets"], blocks, self.s.parent_chunk_max_tokens, self.s.child_chunk_size))
            if skip_quality_failures:
                bad = quality.blocked(stats).select("doc_id")
                made = {n: t.join(bad, "doc_id", "left_anti") if "doc_id" in t.columns else t for n, t in made.items()}
            counters = quality.merged(stats).first().asDict()
            warnings = [r.warning for r in quality.mojibake_warnings(pieces).collect()]
            if not dry_run:
                self.publish(made, reset)
            return {"statuses": statuses, "counters": counters, "warnings": warnings}
        finally:
            self._unstage(stage)

    def _papers(self, pdfs: DataFrame, found: DataFrame, folders: list[str], stage: str) -> DataFrame:
        """PDF files (path, content_hash) with their sidecars' texts, or their own pages'."""
        sides = discovery.sidecars(pdfs, found)
        paths = sides.select(F.explode(F.array("layout_path", "tei_path")).alias("path")).where("path is not null").distinct()
        rows = formats.with_sidecars(pdfs.withColumn("file_type", F.lit("pdf")), sides, formats.contents(self.spark, folders, paths))
        rows = self._staged(stage, "sidecars", rows)
        # files without a sidecar that can be read give their text layer, if they have one
        found = pdf.pages(formats.contents(self.spark, folders, rows.where("error is not null")))
        found = self._staged(stage, "pages", found)
        listed = found.where("trim(text) <> ''").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
        seen = pdf.probe(found, self.s.ocr, self.s.ocr_min_text_chars).select("path", F.col("error").alias("fault"), "n_pages", F.col("ocr.reason").alias("ocr"))
        rows = rows.join(listed, "path", "left").join(seen, "path", "left")
        own = F.when(F.col("pages").isNotNull(), None).when(F.col("n_pages").isNotNull(), formats.failure("needs_ocr", "no page has text"))
        told = formats.failure_of(F.col("error.reason"), F.concat_ws("; ", "error.message", F.concat(F.lit("pdf: "), "fault")))
        error = F.when(F.col("error").isNull() | F.col("pages").isNotNull(), None).otherwise(F.coalesce(own, told))
        return rows.select("path", "file_type", "content_hash", "layout", "tei", "pages", "ocr", error.alias("error"))

    def publish(self, made: dict[str, DataFrame], reset: bool = False) -> int:
        """Adds tables as a segment; documents of the same paths and failures of paths that are read now go."""
        fresh = made["documents"].select("source_path")
        old = self.store.table("documents").join(fresh, "source_path", "left_semi").select("doc_id")
        version = self.store.add(made, self.write_index, None if reset else old, {"failures": fresh.withColumnRenamed("source_path", "path")}, anew=reset)
        if len(self.store.segments(version)) > self.s.segments_before_compaction:
            version = self.store.compact(index=self.write_index) or version
            self.store.vacuum()
        return version

    def failures(self) -> DataFrame:
        """path, file_type, content_hash, reason, message, failed_at of files whose last ingest failed."""
        return self.store.table("failures")

    def _tokens(self):
        return self._bag("embedding_text")

    def _bag(self, text: str):
        """The search terms of a column: Chinese words where the settings name a table of their frequencies (word, n)."""
        if self.s.word_frequencies_path:
            frequencies = self.spark.read.parquet(self.s.word_frequencies_path)
            return segment.search_tokens_by_words(text, frequencies, self._terms(), self.s.cjk_bigrams)
        return X.search_tokens(text, self.s.tokenizer, self._terms(), self.s.cjk_bigrams)

    def _terms(self) -> list[str]:
        if not self.s.domain_terms_path:
            return []
        lines = (r.value.strip() for r in self.spark.read.text(self.s.domain_terms_path).toLocalIterator())
        return [line for line in lines if line and not line.startswith("#")]

    def write_index(self, segment: str, entry: dict) -> None:
        """The indexes of a segment's own child chunks and vectors, before anybody reads it; few vectors are scanned without one."""
        if entry["rows"].get("child_vectors", 0) >= self.s.vectors_before_index:
            vectors = numbered(self.spark.read.schema(self.store.schemas["child_vectors"]).parquet(f"{segment}/rows/child_vectors"))
            vector_index.write(vectors, vector_index.train(vectors), f"{segment}/vectors")
            entry["vectors"] = True
        if entry["rows"].get("child_chunks"):
            kids = self.spark.read.schema(self.store.schemas["child_chunks"]).parquet(f"{segment}/rows/child_chunks")
            bm25.write_segment(kids, "child_id", self._tokens(), f"{segment}/bm25")

    def lexical_index(self) -> bm25.Index:
        """The index of all segments, merged as it is read."""
        segments = self.store.segments()
        folders = [f"{self.folder}/segments/{s['name']}/bm25" if s["rows"].get("child_chunks") else None for s in segments]
        return bm25.merged(self.spark, folders, self.store.gone("child_chunks", segments))

    def near(self, asked: DataFrame, k: int) -> DataFrame:
        """query_id, doc_key, rank, score of the nearest child vectors: from the indexes of large segments and a scan of the small ones."""
        segments = self.store.segments()
        indexed = [n for n, s in enumerate(segments) if s.get("vectors")]
        rows = numbered(self.store.live("child_vectors", segments).where(~F.col("__seq").isin(indexed)).drop("__seq"))
        found, gone = dense.nearest(rows, asked, k).join(rows.select("vec_id", "child_id"), "vec_id").select("query_id", "child_id", "distance"), self.store.gone("child_vectors", segments)
        for n in indexed:
            index = vector_index.read(self.spark, f"{self.folder}/segments/{segments[n]['name']}/vectors")
            dead = None if gone is None else gone.where(F.col("__until") > n).select(F.xxhash64("__gone").alias("vec_id"))
            part = vector_index.search(index, asked, k, exact=self.s.exact_neighbours, gone=dead).join(index.vectors.select("vec_id", "child_id"), "vec_id")
            found = found.unionByName(part.select("query_id", "child_id", "distance"))
        ranked = ranking.ranked(found, "distance", F.xxhash64("child_id")).where(F.col("rank") < k)
        return ranked.select("query_id", F.col("child_id").alias("doc_key"), "rank", (1 / (1 + F.col("distance"))).alias("score"))

    def delete(self, doc_ids: list[str]) -> None:
        self.store.delete(self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string"))

    def status(self) -> dict:
        from ..sources.store import counts

        return {r.name: r.n for r in counts(self.store.tables()).collect()}

    def is_empty(self) -> bool:
        return not self.store.table("child_chunks").take(1)

    # --- retrieve ---

    def hits(self, queries: DataFrame) -> DataFrame:
        """Fused (and reranked) child hits of a batch of queries (query_id, question)."""
        s, half = self.s, self.s.retrieval_top_k // 2
        index = self.lexical_index()
        words = self._bag("question")
        kids = self.store.table("child_chunks").select(F.col("child_id").alias("doc_key"), "child_id", "parent_id", "text")
        lexical = bm25.top(bm25.scores(index, queries, "query_id", words), half).withColumn("method", F.lit("bm25"))
        asked = queries.select("query_id", embedded(F.col("question"), self.make_embedder).alias("embedding"))
        near = self.near(asked, half).withColumn("method", F.lit("dense"))
        keyed = lambda h: h.join(kids.select("doc_key", "parent_id"), "doc_key").withColumn("child_id", F.col("doc_key")).drop("doc_key").withColumnRenamed("parent_id", "doc_key")
        fused = ranking.hybrid(keyed(near).drop("child_id"), keyed(lexical).drop("child_id")).where(F.col("rank") < s.retrieval_top_k)
        first = keyed(near).select("query_id", "doc_key", "child_id", "rank", F.lit(0).alias("list")).unionByName(keyed(lexical).select("query_id", "doc_key", "child_id", "rank", F.lit(1).alias("list")))
        best = first.groupBy("query_id", "doc_key").agg(F.min_by("child_id", F.struct("list", "rank")).alias("child_id"))
        rows = fused.join(best, ["query_id", "doc_key"]).withColumnRenamed("doc_key", "parent_id").join(kids.select("child_id", "text"), "child_id").join(queries, "query_id")
        if s.use_rerank:
            rows = ranking.rerank(rows, ranking.overlap_scorer(F.col("question"), F.col("text")), s.retrieval_top_k)
        return rows

    def documents_of(self, queries: DataFrame) -> DataFrame:
        """The context documents of each query, in order: parents, else child hits."""
        found = self.hits(queries)
        if not self.s.expand_to_parent:
            return found.where(F.col("rank") < self.s.final_k)
        parents = self.store.table("parent_chunks").select("parent_id", "title", "section_path", "source_path", "page_start", "page_end", "text")
        out = ranking.expand(found.select("query_id", "rank", "child_id", "parent_id", "score"), parents, self.s.context_parent_top_k)
        assets = self.store.table("assets").select("parent_id", "asset_index", "asset_type", "label")
        return ranking.with_assets(out, assets).withColumn("page", X.page_label(F.col("page_start"), F.col("page_end")))

    def retrieve(self, question: str, chat: Chat | None = None) -> dict:
        """The context documents and citations of one question; with a model, fused with those of a hypothetical passage."""
        texts = [question]
        if self.s.use_hyde and chat is not None:
            try:
                passage = chat.generate(prompts.hypothetical(question), max_tokens=300)
            except Exception:
                passage = ""
            texts += [passage] if passage.strip() else []
        asked = self.spark.createDataFrame(list(enumerate(texts)), "query_id long, question string")
        rows = [r.asDict() for r in self.documents_of(asked).orderBy("query_id", "rank").collect()]
        if len(texts) > 1:
            rank: dict[str, float] = {}
            first: dict[str, dict] = {}
            for r in rows:
                rank[r["parent_id"]] = rank.get(r["parent_id"], 0.0) + 1 / (ranking.RRF_K + r["rank"] + 1)
                first.setdefault(r["parent_id"], r)
            rows = sorted(first.values(), key=lambda r: -rank[r["parent_id"]])[: self.s.final_k]
        cited = [{"citation_id": r.get("citation_id") or f"S{n}", "title": r.get("title"), "page": r.get("page"), "section": r.get("section_path"), "source_path": r.get("source_path")} for n, r in enumerate(rows, 1) if r.get("parent_id")]
        return {"documents": rows, "citations": cited}


def embedder_of(model: Embedder):
    return lambda: model
