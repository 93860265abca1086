"""One facade over the operators: ingest, search, graph, conflicts and abilities of a stored knowledge base.

Every call reads the current snapshots and gives a DataFrame; calls that
change knowledge write new snapshots.  Missing things raise :class:`NotFound`.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from threading import RLock

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions.embed import backend
from .operators import ability, chunk, evolve, extract, graph, identity, relate, search, store, synthesis
from .sources import readers
from .sources.tables import written
from .streaming import crystallize
from .streaming.bus import Bus

UNIT = "ku_id string, ku_type string, name string, summary string, confidence double, status string, domain string, tags array<string>, sources array<string>, extra struct<claim_status: string, supports: array<string>, definition: string, statement: string, source_text: string>, ord bigint, doc_id string"
EDGE = "rel_id string, from_ku string, to_ku string, rel_type string, weight double, ord bigint"
CARD = "conflict_id string, claim_a_id string, claim_b_id string, domain string, status string, resolution_strategy string, winner string, loser string, resolution_note string, resolved_by string"
CACHE = "ku_id string, content string, digest string"
SEEN = "key string"
JOB = "job_id string, status string, detail string, done int, total int, created_at timestamp"
INDEX = {"postings": "id string, term string, tf bigint", "lengths": "id string, ord bigint, dl bigint", "terms": "term string, df bigint", "vectors": "id string, v array<float>"}
MODES = tuple("hybrid graph vector bm25".split())
PROVIDERS = ("anthropic", "openai", "deepseek", "local")
MAX_JOBS = 200


class NotFound(LookupError):
    """No such unit, ability, card or job."""


class Invalid(ValueError):
    """Input that a guard refuses."""


class Engine:
    """A knowledge base in a folder that all executors share.

    The search index is a part of it: what is ingested is added to the index,
    and searches read it and write nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, extractor: Callable[[str], str] = extract.rule_extractor, taxonomy: DataFrame | None = None, complete: Callable[[str], str] | None = None, get: Callable[[str], str] | None = None, embedder: Callable[[Column], Column] | None = None, parse_pdf: Callable | None = None, workers: int = 2):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.store = store.Store(spark, f"{self.folder}/tables")
        self.bus = Bus(spark, f"{self.folder}/events")
        self.extractor, self.taxonomy, self.client, self.parse_pdf = extractor, taxonomy, get, parse_pdf
        self.embedder = embedder or backend("auto")
        self.translators = dict(crystallize.TRANSLATORS)
        self._pool = ThreadPoolExecutor(workers, thread_name_prefix="ingest")
        self._lock, self._jobs_lock = RLock(), RLock()
        self.complete = complete or (lambda text: text.split("\n", 1)[0])
        self.settings = {"provider": "local", "model": "", "api_key": ""}

    # --- tables ---

    def units(self) -> DataFrame:
        return self.store.read("ku", UNIT)

    def relations(self) -> DataFrame:
        return self.store.read("relations", EDGE)

    def cards(self) -> DataFrame:
        return self.store.read("cards", CARD)

    # --- ingest ---

    def ingest(self, docs: DataFrame, domain: str = "", markdown: bool = True) -> DataFrame:
        """Documents (doc_id, title, source, text) to units; counts by type of what came in.

        Text to chunks to extractions to units and edges, then identity (equal
        units merge into the earliest), relation discovery, and conflicts.
        """
        with self._lock:  # one writer at a time; readers see the last finished snapshots
            return self._ingest(docs, domain, markdown)

    def _ingest(self, docs: DataFrame, domain: str, markdown: bool) -> DataFrame:
        docs = written(docs, "ingest")
        bad = docs.where(F.col("text").isNull() | (F.length("text") > readers.MAX_CHARS)).select("doc_id", F.length("text").alias("n")).first()
        if bad:
            raise readers.TooLarge(f"{bad.doc_id}: {bad.n} characters, over {readers.MAX_CHARS}") if bad.n else Invalid(f"{bad.doc_id}: no text")
        split = chunk.markdown_chapters(docs) if markdown else chunk.text_chapters(docs).withColumn("title", F.lit(""))
        found = written(extract.extract(chunk.chunks(split), self.extractor), "extractions")
        raw, links = extract.package(found, docs, domain)
        old = self.units()
        base = old.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] + 1
        claim = F.when(F.col("ku_type") == "Claim", "pending")
        new = store.numbered(written(raw, "packaged"), "doc_id", "ord", "ku_id", base=base - 1).select("ku_id", "ku_type", "name", "summary", "confidence", "status", "domain", F.array().cast("array<string>").alias("tags"), "sources", F.struct(claim.alias("claim_status"), "supports", F.when(F.col("ku_type") == "Concept", F.col("summary")).alias("definition"), F.when(F.col("ku_type").isin("Fact", "Claim"), F.col("summary")).alias("statement"), F.lit("").alias("source_text")).alias("extra"), F.col("number").alias("ord"), F.col("doc_id").cast("string").alias("doc_id"))
        new = written(new.join(old.select("ku_id"), "ku_id", "left_anti").select(*old.columns), "new-units")
        found_edges = relate.discover(new, old.where("status = 'active'")).drop("rule").unionByName(links.drop("doc_id")).distinct()
        edges = found_edges.select(F.concat_ws(":", "rel_type", "from_ku", "to_ku").alias("rel_id"), "from_ku", "to_ku", "rel_type", "weight", F.abs(F.xxhash64("from_ku", "to_ku", "rel_type")).alias("ord"))
        ku, rel, _ = identity.collapse(old.unionByName(new), store.insert_ignore(self.relations(), edges, "rel_id"))
        ku = self.store.write("ku", ku.select(*old.columns))
        self.store.write("relations", rel.select("rel_id", "from_ku", "to_ku", "rel_type", "weight", "ord"))
        self._evolve(ku, new)
        self._index(ku.join(new.select("ku_id"), "ku_id", "left_semi"))
        self.bus.publish(new.agg(F.to_json(F.struct(F.count("*").alias("count"))).alias("payload")).select(F.lit("knowledge.created").alias("event"), F.lit("ingest").alias("source"), "payload"))
        return store.ingest_counts(new)

    def _evolve(self, ku: DataFrame, new: DataFrame) -> None:
        """The new claims against all of their domain, in order of arrival: evidence, confidence, statuses, cards and their events."""
        fresh = new.where("ku_type = 'Claim'").select("ku_id", F.lit(True).alias("fresh"))
        claims = ku.where("ku_type = 'Claim' AND status = 'active'").select("ku_id", F.coalesce("domain", F.lit("")).alias("domain"), "confidence", F.col("extra.supports").alias("supports"), F.col("extra.claim_status").alias("claim_status"), F.col("extra.statement").alias("statement"), "ord")
        claims = written(claims.join(fresh, "ku_id", "left"), "claims")
        if claims.where("fresh").isEmpty():
            return
        touched = claims.join(claims.where("fresh").select("domain").distinct(), "domain", "left_semi")
        after = written(evolve.folded(touched).select("ku_id", F.col("claim_status").alias("_status"), F.col("confidence").alias("_confidence"), F.col("supports").alias("_supports")), "folded")
        one = lambda side: claims.where("fresh").select(F.col("ku_id").alias(side))
        pairs = evolve.pairs(touched, opposing=True)
        opposed = pairs.join(one("a"), "a", "left_semi").unionByName(pairs.join(one("b"), "b", "left_semi")).distinct()
        own = F.concat_ws(":", F.lit("CFL"), "claim_a_id", "claim_b_id")
        found = evolve.cards(opposed).select(own.alias("conflict_id"), "claim_a_id", "claim_b_id", "domain", "status", "resolution_strategy", "winner", "loser", F.lit(None).cast("string").alias("resolution_note"), F.lit(None).cast("string").alias("resolved_by"))
        old = self.cards()
        cards = written(found.join(old.select("conflict_id"), "conflict_id", "left_anti").select(*old.columns), "cards")
        self.store.write("cards", old.unionByName(cards))
        out = ku.join(after, "ku_id", "left")
        extra = F.col("extra").withField("claim_status", F.coalesce("_status", "extra.claim_status")).withField("supports", F.coalesce("_supports", "extra.supports"))
        self.store.write("ku", out.withColumn("extra", extra).withColumn("confidence", F.coalesce("_confidence", "confidence")).select(*ku.columns))
        changed = after.join(claims.select("ku_id", F.col("claim_status").alias("old_status")), "ku_id").where("_status != old_status")
        self._publish("claim.status_changed", changed.select("ku_id", "old_status", F.col("_status").alias("new_status")))
        self._publish("conflict.detected", cards.select("conflict_id", F.col("claim_a_id").alias("claim_a"), F.col("claim_b_id").alias("claim_b"), "domain"))
        self._publish("conflict.resolved", cards.where("status = 'resolved'").select("conflict_id", "winner", "loser"))

    def _publish(self, event: str, rows: DataFrame, source: str = "evolution") -> None:
        """An event a row, with the row as its payload."""
        self.bus.publish(rows.select(F.lit(event).alias("event"), F.lit(source).alias("source"), F.to_json(F.struct(*rows.columns)).alias("payload")))

    def _texts(self, units: DataFrame) -> DataFrame:
        """(ku_id, ord, text, long): what words and what vectors are made of."""
        bag = search.document_text(F.col("name"), F.col("summary"), F.col("tags"))
        return units.where("status = 'active'").select("ku_id", "ord", bag.alias("text"), F.concat_ws(" ", bag, F.coalesce("extra.statement", F.lit(""))).alias("long"))

    def _index(self, units: DataFrame) -> None:
        """Add units to the index: rows to postings, lengths and vectors, a merge to the term statistics."""
        rows = self._texts(units)
        more, have = search.index(rows, "ku_id", "text", "ord"), self.store.read("terms", INDEX["terms"])
        self.store.append("postings", search.by_term(more.postings))
        self.store.append("lengths", more.lengths)
        self.store.append("vectors", rows.select(F.col("ku_id").alias("id"), self.embedder(F.col("long")).alias("v")).withColumn("v", search.normalized(F.col("v"))))
        self.store.write("terms", have.unionByName(more.terms).groupBy("term").agg(F.sum("df").alias("df")))

    def reindex(self) -> None:
        """The index made anew, of the units active now."""
        with self._lock:
            self.store.clear(INDEX)
            self._index(self.units())

    def index(self) -> search.Index:
        return search.Index(*(self.store.read(t, INDEX[t]) for t in search.TABLES))

    def ingest_text(self, text: str, *, title: str = "", source: str = "inline", domain: str = "") -> DataFrame:
        if not text.strip():
            raise Invalid("blank text")
        if len(text) > readers.MAX_CHARS:
            raise readers.TooLarge(f"{len(text)} characters, over {readers.MAX_CHARS}")
        rows = readers.inline(self.spark.createDataFrame([(text,)], "text string"), source)
        return self.ingest(rows.withColumn("title", F.lit(title)) if title else rows, domain)

    def ingest_files(self, path: str, domain: str = "") -> DataFrame:
        return self.ingest(readers.read_any(self.spark, path, self.parse_pdf), domain)

    def ingest_url(self, url: str, domain: str = "") -> DataFrame:
        pages = written(readers.fetch(self.spark.createDataFrame([(url,)], "url string"), self.client), "pages")
        if pages.where("html IS NOT NULL").isEmpty():
            raise NotFound(url)
        return self.ingest(readers.html_pages(pages), domain, markdown=False)

    def crystallize(self, candidates: DataFrame) -> DataFrame:
        """Candidates (ord, title, content, event_refs, evidence, domain_hint) to units; their outcomes.

        Keys of what was taken in are remembered, after success only, so a
        batch that failed can be fed again and one that did not adds nothing.
        """
        seen = self.store.read("seen", SEEN)
        if "translated" not in candidates.columns:
            candidates = candidates.withColumn("translated", F.lit(True))
        rows = crystallize.outcomes(candidates).join(seen.withColumn("_seen", F.lit(True)), "key", "left")
        rows = written(rows.withColumn("outcome", F.when((F.col("outcome") == "crystallized") & F.col("_seen"), "skipped_dup").otherwise(F.col("outcome"))).drop("_seen"), "candidates")
        text = crystallize.ingest_text(F.col("title"), F.col("content"))
        source = crystallize.source_string(F.col("evidence")) if "evidence" in rows.columns else F.lit("knowledge_candidate")
        good = rows.where("outcome = 'crystallized'")
        if not good.isEmpty():
            self.ingest(good.select(F.concat(F.lit("DOC_"), F.substring(F.sha2(F.concat_ws("|", "key", text), 256), 1, 8)).alias("doc_id"), "title", source.alias("source"), text.alias("text")))
            self.store.write("seen", seen.union(good.select("key")).distinct())
        return crystallize.counters(rows)

    def crystallize_events(self, events: DataFrame) -> DataFrame:
        """Events (ord, event, payload) by their translators to units; their outcomes."""
        return self.crystallize(crystallize.translate(events, self.translators))

    def register_translator(self, event: str, translator: crystallize.Translator) -> None:
        """Events of that type become candidates by ``translator``, in place of the one before."""
        self.translators[event] = translator

    def subscribe_crystallizer(self, checkpoint: str, every: str | None = "1 second") -> list[StreamingQuery]:
        """The bus's events that have a translator, crystallized as they are published."""
        numbered = lambda batch: batch.select(F.xxhash64("event_id").alias("ord"), "event", "payload")
        return [self.bus.subscribe(f"crystallize {e}", e, lambda batch, _: self.crystallize_events(numbered(batch)), f"{checkpoint}/{e}", every) for e in self.translators]

    def consume(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Crystallize every micro-batch of a stream of candidates."""
        return crystallize.run(stream, lambda batch, _: self.crystallize(batch), checkpoint)

    def forget_events(self) -> None:
        """Events seen before count as new again."""
        self.store.write("seen", self.spark.createDataFrame([], SEEN))

    def reset(self) -> int:
        """Empty every table; the number of units there were."""
        return self.store.clear({"ku": UNIT, "relations": EDGE, "cards": CARD, "cache": CACHE, "seen": SEEN} | INDEX)

    # --- units and graph ---

    def get(self, ku_id: str) -> DataFrame:
        row = store.point_lookup(self.units(), ku_id)
        if row.isEmpty():
            raise NotFound(ku_id)
        return row

    def list_by_domain(self, name: str, limit: int = 50) -> DataFrame:
        return store.by_domain(self.units(), name, limit)

    def graph(self, limit: int = 2000) -> tuple[DataFrame, DataFrame]:
        """Capped active units without their source text, and the edges among them."""
        limit = max(1, min(5000, limit))
        return store.response(store.capped_per_type(self.units(), limit), False), store.induced(self.units(), self.relations(), limit)

    def neighbors(self, ku_id: str, depth: int = 2, limit: int = 20, rel_types: list[str] | None = None) -> DataFrame:
        self.get(ku_id)
        seed = self.spark.createDataFrame([(ku_id,)], "seed string")
        return graph.ranked(graph.bfs(self.relations(), seed, depth, rel_types), self.units(), limit)

    def find_path(self, start: str, goal: str) -> DataFrame:
        return graph.shortest_path(self.relations(), start, goal)

    # --- search ---

    def search(self, text: str, mode: str = MODES[0], limit: int = 10, *, exclude_inactive: bool = True, ku_types: list[str] | None = None, domain: str = "") -> DataFrame:
        """(id, score, …): the best units in one of the four modes."""
        if mode not in MODES:
            raise Invalid(f"mode {mode!r}")
        words = lambda k: search.bm25(self.index(), text, k)

        def vectors(k: int) -> DataFrame:
            q = self.spark.createDataFrame([(text,)], "t string").select(self.embedder(F.col("t")).alias("q")).withColumn("q", search.normalized(F.col("q")))
            return search.vector(self.store.read("vectors", INDEX["vectors"]), q, k, id_column="id", column="v")

        if mode == "bm25":
            hits = words(2 * limit)
        elif mode == "vector":
            hits = vectors(2 * limit)
        elif mode == "graph":
            hits = graph.graph_mode(self.relations(), self.units(), words(3), 2 * limit).select(F.col("node").alias("id"), "score")
        else:
            hits = search.fuse(words(search.ARM), vectors(search.ARM), top_k=2 * limit)
        kept = search.post_filter(hits.select("id", "score"), self.units(), domain=domain, ku_types=ku_types, exclude_inactive=exclude_inactive)
        return kept.orderBy(F.desc("score"), "id").limit(limit)

    # --- synthesis ---

    def synthesis(self, ku_id: str, force: bool = False) -> DataFrame:
        """(ku_id, content, digest): from the cache while the context is the same."""
        unit = self.get(ku_id)
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank")  # at most twenty rows
        near = self.neighbors(ku_id, 2, synthesis.NEIGHBORS).select(F.col("node").alias("id"), "name", "summary", "score").select("id", "name", "summary", rank)
        hits = self.search(unit.first().name, limit=synthesis.HITS).join(self.units().select(F.col("ku_id").alias("id"), "name", "summary"), "id").select("id", "name", "summary", rank)
        cache = self.store.read("cache", CACHE)
        new = synthesis.generate(written(synthesis.context(unit, near, hits), "context"), cache, self.complete, force)
        return self.store.write("cache", new).where(F.col("ku_id") == ku_id)

    # --- abilities ---

    def _taxonomy(self, key: str | None = None) -> DataFrame:
        if self.taxonomy is None:
            raise NotFound("no taxonomy")
        rows = self.taxonomy if key is None else self.taxonomy.where(F.col("ability_key") == key)
        if rows.isEmpty():
            raise NotFound(str(key))
        return rows

    def list_abilities(self) -> DataFrame:
        return self._taxonomy().select("ability_key")

    def coverage_report(self, key: str) -> tuple[DataFrame, DataFrame]:
        """(report, coverage by skill)."""
        tax = self._taxonomy(key)
        pool = ability.pool(self.units(), tax)
        cov = ability.coverage(ability.hits(ability.checklist(tax), pool))
        return ability.report(tax, cov, pool), cov

    def compile_ability(self, key: str) -> DataFrame | None:
        """The compiled package, written to a file of its own; None below the gate."""
        tax = self._taxonomy(key)
        pool, items = ability.pool(self.units(), tax), ability.checklist(tax)
        hits = ability.hits(items, pool)
        cov = ability.coverage(hits)
        rows = written(ability.packages(tax, ability.skills(items, pool, cov, hits), ability.report(tax, cov, pool)), "packages")
        if rows.isEmpty():
            return None
        ability.write_packages(rows, f"{self.folder}/abilities/{key}")
        self.bus.publish(rows.select(F.lit("ability.created").alias("event"), F.lit("abilities").alias("source"), F.col("ability_key").alias("payload")))
        return self.get_ability(key)

    def get_ability(self, key: str) -> DataFrame:
        fs, path = self.store._fs(f"{self.folder}/abilities/{key}")
        if not fs.exists(path):
            raise NotFound(key)
        return ability.load_package(self.spark, f"{self.folder}/abilities/{key}", key)

    def ensure_ability(self, key: str) -> DataFrame | None:
        try:
            return self.get_ability(key)
        except NotFound:
            return self.compile_ability(key)

    # --- conflicts, operation ---

    def list_conflicts(self, *, domain: str = "", status: str = "open") -> DataFrame:
        return store.conflicts(self.cards(), domain=domain, status=status)

    def resolve_conflict(self, conflict_id: str, winner: str, note: str = "", by: str = "human") -> bool:
        """Settle an open card for a claim; False if there is no such open card."""
        before = self.cards()
        if before.where((F.col("conflict_id") == conflict_id) & (F.col("status") == "open")).isEmpty():
            return False
        after, units = evolve.manual_resolve(before, self.units(), conflict_id, winner, note, by)
        self.store.write("cards", after)
        self.store.write("ku", units)
        self._publish("conflict.resolved", after.where(F.col("conflict_id") == conflict_id).select("conflict_id", F.lit(winner).alias("winner"), F.lit(by).alias("resolved_by")))
        return True

    def stats(self) -> DataFrame:
        return store.stats(self.units(), self.relations(), self.cards())

    def recent_events(self, limit: int = 50, event: str = "") -> DataFrame:
        return self.bus.recent(limit, event)

    def health(self) -> bool:
        return self.units().limit(1).count() >= 0

    def config(self) -> dict[str, str]:
        """Model settings with the key masked."""
        key = self.settings["api_key"]
        return self.settings | {"api_key": f"{key[:3]}…{key[-2:]}" if len(key) > 8 else "*" * len(key)}

    def set_config(self, **settings: str) -> dict[str, str]:
        if settings.get("provider", self.settings["provider"]) not in PROVIDERS:
            raise Invalid("unknown provider")
        self.settings |= {k: v for k, v in settings.items() if k in self.settings}
        return self.config()

    # --- jobs ---

    def _put_job(self, job_id: str, status: str, detail: str = "", done: int = 0, total: int = 0) -> None:
        """Set a job's row; the oldest finished beyond ``MAX_JOBS`` go, those under way never."""
        with self._jobs_lock:
            jobs = self.store.read("jobs", JOB)
            row = self.spark.createDataFrame([(job_id, status, detail[:500], done, total)], "job_id string, status string, detail string, done int, total int")
            row = row.join(jobs.select("job_id", F.col("created_at").alias("_t")), "job_id", "left").withColumn("created_at", F.coalesce("_t", F.current_timestamp())).drop("_t")
            over = F.col("status").isin("done", "error")
            last = F.row_number().over(Window.partitionBy(over).orderBy(F.desc("created_at"), "job_id"))
            rows = jobs.where(F.col("job_id") != job_id).unionByName(row).withColumn("_r", last)
            self.store.write("jobs", rows.where(~over | (F.col("_r") <= MAX_JOBS)).drop("_r"))

    def submit(self, job_id: str, action: Callable[[Callable[[int, int], None]], object]) -> Future:
        """Run an ingest in the background as a job: queued, running, then done or error.

        ``action`` is given a function that notes progress (done, total).  The
        call returns at once; :meth:`job` tells how far it is.
        """
        self._put_job(job_id, "queued")

        def run() -> str:
            self._put_job(job_id, "running")
            at = [0, 0]

            def progress(done: int, total: int) -> None:
                at[:] = done, total
                self._put_job(job_id, "running", "", done, total)

            try:
                action(progress)
            except Exception as e:  # noqa: BLE001 - the job's row tells of it
                self._put_job(job_id, "error", f"{type(e).__name__}: {e}", *at)
                return "error"
            self._put_job(job_id, "done", "", max(at), max(at))
            return "done"

        return self._pool.submit(run)

    def job(self, job_id: str) -> DataFrame:
        with self._jobs_lock:
            row = self.store.read("jobs", JOB).where(F.col("job_id") == job_id)
            if row.isEmpty():
                raise NotFound(job_id)
            return row

    def close(self) -> None:
        """End the subscriptions and wait for the jobs."""
        self.bus.close()
        self._pool.shutdown()


__all__ = ["Engine", "Invalid", "NotFound"]
