"""Queries of the ledger tables: ledger, audit, retrieval, context, text and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udf as U
from ..operators import audit as A
from ..operators import canonical as C
from ..operators import context as X
from ..operators import digest as D
from ..operators import facts as L
from ..operators import retrieval as R
from ..operators import scoring as S
from ..operators.hierarchy import expand_paths, resolve_references
from ..sources import episodes as E
from .problems import forests, table
from .scratch import Scratch


class Tables:
    """The canonical tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        t = lambda name: table(spark, folder, name)
        self.raw = C.raw_turns(t("raw_records"))
        self.archive = C.archived(t("archived_summaries"))
        self.active = C.active(t("active_summaries"), self.archive)
        self.entries = C.index_entries(t("index_entries"))
        self.ledger = C.ledger(t("fact_ledger"))
        self.probes = C.probes(t("probe_predictions"))
        self.stored = t("fact_history")
        self.handed = t("fact_ledger")
        self.documents = t("documents")
        self.scratch = Scratch(spark, "ledger")

    @property
    def summaries(self) -> DataFrame:
        cols = ["summary_id", "episode_id", "seq", "text", "fact_keys"]
        return self.active.select(*cols, F.lit(True).alias("live")).unionByName(self.archive.select(*cols, F.lit(False).alias("live")))


QUERIES = {}


def query(function):
    """Register a query on the canonical tables."""
    QUERIES[function.__name__] = lambda spark, folder: function(Tables(spark, folder))
    return function


# --- ledger and time ---


@query
def ledger_append_dedupe(m):
    return m.ledger.select("fact_id", "episode_id", "summary_id", "slot", "seq", F.coalesce("observed_turn", F.lit(-1)).alias("observed_turn"), "erased")


@query
def current_by_slot(m):
    return L.current(m.ledger)


def _closed(df):
    return df.withColumn("valid_to_turn", F.coalesce("valid_to_turn", F.lit(-1))).withColumn("superseded_by", F.coalesce("superseded_by", F.lit("")))


@query
def scd2_projection(m):
    return _closed(L.projection(m.ledger))


@query
def history_asof(m):
    return _closed(L.projection(m.ledger, 10))


@query
def temporal_anomalies(m):
    return L.anomalies(m.stored.withColumn("slot", C.slot_key(F.col("slot"))).filter(F.col("slot").isNotNull() & F.col("episode_id").isNotNull()))


@query
def registry_topn(m):
    return L.registry(m.active, 12)


@query
def registry_rendered(m):
    return L.rendered_registry(L.registry(m.active, 12))


@query
def ledger_stats(m):
    return m.ledger.groupBy("episode_id").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("slot").alias("slots"), F.count_if(F.col("reason") != "").alias("left_facts"))


@query
def reason_counts(m):
    return m.ledger.filter(F.col("reason") != "").groupBy("episode_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def reason_by_summary(m):
    return m.ledger.filter(F.col("reason") != "").groupBy("summary_id").agg(F.min(F.struct("seq", "fact_id", "reason")).alias("r")).select("summary_id", F.col("r.reason").alias("reason"))


@query
def tombstones(m):
    doomed = m.ledger.filter(F.col("reason") == "capacity").select("fact_id")
    return A.erase(m.ledger, doomed).filter("erased").select("episode_id", "fact_id", F.coalesce("value", F.lit("")).alias("value"), F.size("evidence").alias("evidence_n"))


@query
def ledger_episodes(m):
    return m.ledger.filter(F.coalesce("episode_id", F.lit("")) != "").select("episode_id").distinct()


# --- stores ---


@query
def raw_upsert(m):
    return m.raw.select("reference_id", "episode_id", F.coalesce("turn_index", F.lit(-1)).alias("turn_index"), F.coalesce("user_msg", F.lit("")).alias("user_msg"))


@query
def archive_upsert(m):
    return m.archive.select("summary_id", "episode_id", "seq", "archive_reason", "is_overridden")


@query
def active_remaining(m):
    return m.active.select("summary_id", "episode_id", "seq", "index_id")


@query
def duplicate_ids(m):
    ids = m.summaries.select("summary_id")
    return ids.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("summary_id").alias("n_distinct"))


@query
def table_counts(m):
    each = {"raw_records": m.raw, "archived_summaries": m.archive, "active_summaries": m.active, "index_entries": m.entries, "fact_ledger": m.ledger, "probe_predictions": m.probes}
    out = None
    for name, df in each.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query
def resume_antijoin(m):
    done = m.probes.filter(F.col("run_id") == "run-nightly").select("system", "episode_id").distinct()
    return m.probes.select("system", "episode_id").distinct().join(done, ["system", "episode_id"], "left_anti")


# --- audit ---


@query
def i1_conservation(m):
    return A.lost_facts(m.ledger, m.summaries)


@query
def i2_reachability(m):
    return A.unreachable_values(m.ledger, A.visible_text(m.active, m.entries))


@query
def i3_provenance(m):
    return A.unresolved_evidence(m.ledger, m.raw)


@query
def i4_extraction(m):
    return A.extraction(S.all_signals(m.raw, m.scratch), m.ledger)


@query
def extraction_report(m):
    """I4 with recalls in parts per 10000; -1 where nothing was found."""
    rows = A.recalls(A.extraction(S.all_signals(m.raw, m.scratch), m.ledger))
    return rows.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("strict_recall", "all_recall")})


@query
def extraction_gaps(m):
    """Up to twenty strong candidates of each episode that the ledger lacks."""
    return A.gaps(S.all_signals(m.raw, m.scratch), m.ledger)


@query
def i5_deletion(m):
    return A.failed_erasures(m.ledger, m.raw)


@query
def audit_report(m):
    return A.report(m.ledger, m.summaries, m.entries, m.raw)


@query
def audit_full(m):
    """The report with I4 inside."""
    return A.full_report(A.report(m.ledger, m.summaries, m.entries, m.raw), A.extraction(S.all_signals(m.raw, m.scratch), m.ledger))


@query
def audit_all(m):
    return A.summary(A.report(m.ledger, m.summaries, m.entries, m.raw))


def _gold(m):
    """Distinct gold values of the probes that name one."""
    known = m.probes.filter(F.col("fact_key").isNotNull() & (F.length(T.letters_digits(F.col("gold"))) >= 2) & (F.col("probe_type") != "no_history"))
    return known.select("episode_id", C.slot_key(F.col("fact_key")).alias("slot"), F.col("gold").alias("value"), T.letters_digits(F.col("gold")).alias("key")).distinct()


@query
def silent_loss(m):
    return A.silent_loss(_gold(m).select("episode_id", "slot", "key").distinct(), m.ledger, m.summaries)


@query
def residual_mentions(m):
    shown = m.active.select("episode_id", "text").unionByName(m.entries.select("episode_id", F.col("title").alias("text")))
    return A.residual_mentions(m.ledger.filter((F.col("reason") == "overridden") & ~F.col("erased")), shown)


@query
def erasure_plan(m):
    return A.erasure_plan(m.ledger, m.ledger.filter(F.col("reason") == "capacity").select("fact_id"))


@query
def gold_trace(m):
    layers = {
        "raw": m.raw.select("episode_id", F.col("user_msg").alias("text")),
        "archive": m.archive.select("episode_id", "text"),
        "active": m.active.select("episode_id", "text"),
        "index": m.entries.select("episode_id", F.col("title").alias("text")),
    }
    return R.trace(_gold(m).select("episode_id", "slot", "value"), layers)


# --- retrieval ---


@query
def exact_lookup(m):
    return R.lookup(m.ledger.select("summary_id").filter(F.col("summary_id").isNotNull()), m.archive, m.active)


@query
def fact_state(m):
    return R.states(m.ledger, m.archive, m.active)


@query
def evidence_join(m):
    return R.evidence(m.ledger, m.raw).withColumn("turn_index", F.coalesce("turn_index", F.lit(-1)))


@query
def rendered_chain(m):
    return R.unfiled(m.active, m.entries).select("summary_id", "episode_id", "seq")


@query
def expand_index(m):
    return R.members(m.entries, m.active, m.archive)


@query
def predecessor_recorded(m):
    """What each recorded value replaced: by its recorder's override ids, else the newest older summary with another value."""
    cols = ["summary_id", "episode_id", "seq", "ts", "text", "fact_keys"]
    both = m.archive.select(*cols).unionByName(m.active.select(*cols))
    named = override_ids(m).filter(F.col("target") != "")
    return R.anchored(both, m.ledger.filter("erased"), named, m.scratch)


@query
def predecessor_anchor(m):
    """Only the run before in the ledger, as in its SQL; with override ids: ``predecessor_recorded``."""
    return R.predecessors(m.ledger)


@query
def predecessor_fallback(m):
    now = L.current(m.ledger).select("episode_id", "slot", T.letters_digits(F.col("value")).alias("key"))
    return R.newest_other(m.ledger, now)


@query
def override_resolution(m):
    return L.overrides(m.ledger, m.scratch)


@query
def override_ids(m):
    """Override ids of summaries mapped to summaries of any spelling; ``valid`` tells whether one was found."""
    pairs = m.archive.select("summary_id", F.explode("override_ids").alias("ref")).unionByName(m.active.select("summary_id", F.explode("override_ids").alias("ref")))
    short = F.concat(F.regexp_extract("summary_id", r"(?s)^(.*)/[^/]*$", 1), F.lit("/"), T.short_id(F.col("ref")))
    keys = m.summaries.select(F.concat(F.regexp_extract("summary_id", r"(?s)^(.*)/[^/]*$", 1), F.lit("/"), T.short_id(F.col("summary_id"))).alias("k"), F.col("summary_id").alias("target")).distinct()
    named = pairs.filter(F.coalesce("ref", F.lit("")) != "").select("summary_id", "ref", short.alias("k")).distinct()
    return named.join(keys, "k", "left").select("summary_id", "ref", F.coalesce("target", F.lit("")).alias("target"))


# --- context ---


@query
def turn_ordinals(m):
    return X.turn_costs(m.raw)


@query
def sliding_turns(m):
    """The newest four distinct turns."""
    return X.newest_turns(m.raw, 4)


@query
def sliding_window(m):
    """The newest four deliveries, as in its SQL; by turn: ``sliding_turns``."""
    return X.last_turns(m.raw, 4)


@query
def budget_suffix(m):
    return X.newest_within(X.turn_costs(m.raw), 200)


@query
def naive_chain_trim(m):
    costs = m.active.filter(F.col("seq") >= 0).groupBy("episode_id", F.col("seq").alias("turn")).agg(F.sum(U.token_estimate(F.coalesce("text", F.lit("")))).cast("bigint").alias("cost"))
    return X.newest_within(costs, 100, first_always=False)


@query
def full_context_prefix(m):
    return X.oldest_within(X.turn_costs(m.raw), 300)


@query
def baseline_tokens(m):
    return X.running_context(X.turn_costs(m.raw))


@query
def evicted_at_end(m):
    """Closed form, as if checked once at the end: episodes whose turns exceed the budget keep the newest four turns.  By turn: ``evictions_by_turn``."""
    costs = X.turn_costs(m.raw)
    over = costs.groupBy("episode_id").agg(F.sum("cost").alias("all_tokens")).filter(F.col("all_tokens") > 400)
    kept = X.last_turns(m.raw, 4).select("episode_id", F.col("turn_index").alias("turn")).distinct()
    return costs.join(over, "episode_id").join(kept, ["episode_id", "turn"], "left_anti").groupBy("episode_id").agg(F.count(F.lit(1)).alias("evicted"), F.sum("cost").alias("evicted_tokens"))


@query
def evictions_by_turn(m):
    """Turns evicted when the window is checked after every turn: over the budget, all but the newest four leave."""
    return X.evictions(X.turn_costs(m.raw), 400, 4, m.scratch)


@query
def spread_turns(m):
    """Five turns per episode, evenly spread by position, whatever ordinals are missing."""
    return X.spread_sample(X.ranked(X.turn_costs(m.raw)), ["episode_id"], "position", 5).drop("position")


@query
def spread_sample(m):
    """Spread by the turn's number, as in its SQL: where ordinals are missing, rows are lost.  By position: ``spread_turns``."""
    return X.spread_sample(X.turn_costs(m.raw), ["episode_id"], "turn", 5)


@query
def evidence_truncation(m):
    turns = X.turn_costs(m.raw).select("episode_id", "turn")
    evidence = m.ledger.filter(F.col("observed_turn").isNotNull()).select("episode_id", F.col("observed_turn").alias("turn"))
    return X.evidence_budget(turns, evidence, 10)


@query
def episode_metrics(m):
    live = m.active.groupBy("episode_id").agg(F.count(F.lit(1)).alias("active"), F.sum(U.token_estimate(F.col("text"))).alias("active_tokens"), F.count_if(F.coalesce("index_id", F.lit("")) != "").alias("filed"))
    old = m.archive.groupBy("episode_id").agg(F.count(F.lit(1)).alias("archived"), F.count_if(F.col("archive_reason") == "overridden").alias("overridden"), F.count_if(F.col("origin") == "capacity_merge").alias("merged"))
    both = live.join(old, "episode_id", "full_outer")
    return both.select("episode_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("active", "active_tokens", "filed", "archived", "overridden", "merged")])


@query
def token_accounting(m):
    rendered = F.concat(F.lit("- "), T.short_id(F.col("summary_id")), F.lit(" "), F.coalesce("text", F.lit("")))
    lines = R.unfiled(m.active, m.entries).select("episode_id", F.lit("chain").alias("layer"), rendered.alias("line"))
    titles = m.entries.select("episode_id", F.lit("index").alias("layer"), F.concat(F.lit("* "), T.short_id(F.col("index_id")), F.lit(" "), F.coalesce("title", F.lit(""))).alias("line"))
    return lines.unionByName(titles).groupBy("episode_id", "layer").agg(F.count(F.lit(1)).alias("lines"), F.sum(U.token_estimate(F.col("line"))).alias("tokens"))


@query
def protected_set(m):
    """Summaries that hold the newest fact of a slot among the live ones."""
    keys = m.active.select("episode_id", "summary_id", "seq", F.explode("fact_keys").alias("key")).select("episode_id", "summary_id", "seq", T.split_pair(F.col("key")).alias("p")).filter(F.col("p").isNotNull())
    newest = keys.groupBy("episode_id", F.lower("p.slot").alias("slot")).agg(F.max(F.struct("seq", "summary_id")).alias("n"))
    return newest.select("episode_id", F.col("n.summary_id").alias("summary_id")).distinct()


@query
def fact_digest(m):
    """Per index entry and slot: the latest value of its members and up to three earlier ones, oldest first.

    An entry's members are a bounded list, so its values are gathered per entry and slot.
    """
    members = m.entries.select("index_id", F.explode("members").alias("summary_id")).distinct()
    keys = m.summaries.select("summary_id", "seq", F.explode("fact_keys").alias("key")).select("summary_id", "seq", T.split_pair(F.col("key")).alias("p")).filter(F.col("p").isNotNull())
    each = members.join(keys, "summary_id").groupBy("index_id", F.col("p.slot").alias("slot"), F.col("p.value").alias("value")).agg(F.min("seq").alias("seq"))
    values = each.groupBy("index_id", "slot").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("v"))
    ordered = F.transform("v", lambda x: x["value"])
    n = F.size("v")
    history = F.slice(ordered, F.greatest(n - 3, F.lit(1)), F.least(n - 1, F.lit(3)))
    latest = F.element_at(ordered, -1)
    shown = F.concat("slot", F.lit("="), latest, F.when(n > 1, F.concat(F.lit("["), F.array_join(history, "→"), F.lit("→"), latest, F.lit("]"))).otherwise(""))
    return values.select("index_id", "slot", shown.alias("digest"))


@query
def digest_titles(m):
    """The title of an index entry: up to six attributes of its members, the newest first, with their values."""
    return D.digest(D.of_members(m.entries, m.summaries), "index_id", 6)


@query
def merged_digests(m):
    """The title of a super entry: the attributes in its children's digests, up to eight."""
    titled = m.entries.select("index_id", "seq").join(digest_titles(m).withColumnRenamed("digest", "title"), "index_id")
    refs = m.entries.select(F.col("index_id").alias("owner"), F.explode("child_index_ids").alias("ref")).filter(F.col("ref").isNotNull())
    links = resolve_references(refs, m.entries.select(F.col("index_id").alias("id"))).select(F.col("owner").alias("parent"), F.col("target").alias("index_id")).distinct()
    return D.digest(D.of_titles(titled, links), "parent", 8)


# --- text ---


@query
def token_estimate(m):
    return m.documents.select("doc_id", U.token_estimate(F.col("text")).alias("tokens"))


@query
def message_tokens(m):
    cost = U.token_estimate(F.coalesce("user_msg", F.lit(""))) + U.token_estimate(F.coalesce("agent_msg", F.lit(""))) + 2 * 4 + 2
    return m.raw.groupBy("episode_id").agg((F.sum(cost) + 2).alias("tokens"))


@query
def fact_slots(m):
    return m.summaries.select("summary_id", F.explode(T.fact_slots(F.col("text"))).alias("slot")).distinct()


@query
def fact_pairs(m):
    return m.summaries.select("summary_id", F.explode("fact_keys").alias("key")).select("summary_id", T.split_pair(F.col("key")).alias("p")).filter(F.col("p").isNotNull()).select("summary_id", "p.slot", "p.value").distinct()


@query
def summary_grammar(m):
    rows = m.summaries.filter(F.col("text").isNotNull())
    return rows.select(
        "summary_id",
        T.summary_body(F.col("text")).alias("body"),
        F.array_join(T.summary_facts(F.col("text")), ";").alias("facts"),
        F.array_join(T.summary_overrides(F.col("text")), ",").alias("overrides"),
        F.col("text").rlike(T.OVERRIDES).alias("has_tag"),
    )


@query
def previews(m):
    return m.active.select("summary_id", T.preview(F.col("text")).alias("preview"))


@query
def made_ids(m):
    return m.raw.filter(F.col("turn_index").isNotNull()).select("reference_id", T.make_id(F.col("episode_id"), "raw", F.col("turn_index")).alias("made"), T.short_id(F.col("reference_id")).alias("short"))


@query
def fact_episodes(m):
    return m.ledger.select("fact_id", T.episode_of_fact(F.col("fact_id")).alias("episode"), (T.episode_of_fact(F.col("fact_id")) == F.col("episode_id")).alias("same"))


@query
def gate_classify(m):
    return S.gate_signals(S.all_signals(m.raw, m.scratch)).groupBy("episode_id", "kind", "asks").agg(F.count(F.lit(1)).alias("n"))


@query
def candidate_pairs(m):
    return S.gate_signals(S.all_signals(m.raw, m.scratch)).select("reference_id", F.explode("pairs").alias("p")).select("reference_id", "p.slot", "p.value").distinct()


@query
def gate_strict_first_seen(m):
    return S.gate(S.gate_signals(S.all_signals(m.raw, m.scratch))).groupBy("episode_id").agg(F.count_if("keep_pattern").alias("pattern"), F.count_if("keep_strict").alias("strict"), F.count(F.lit(1)).alias("turns"))


@query
def gate_confusion(m):
    evidence = m.ledger.select(F.explode("evidence").alias("reference_id"))
    return S.confusion(S.gate(S.gate_signals(S.all_signals(m.raw, m.scratch))), evidence, ["pattern", "strict"])


@query
def gate_prevalence(m):
    return _prevalence(m, S.gate_signals(S.all_signals(m.raw, m.scratch)))


def _prevalence(m, signals):
    evidence = m.ledger.select(F.explode("evidence").alias("reference_id"), F.lit(True).alias("fact")).distinct()
    both = signals.join(evidence, "reference_id", "left").withColumn("fact", F.coalesce("fact", F.lit(False)))
    return both.groupBy("fact").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.size("pairs") > 0).alias("with_pairs"), F.count_if(F.col("kind") == "change").alias("changes"), F.count_if("asks").alias("questions"))


# the same on all turns, also those without an ordinal, which the SQL of the five above and of i4_extraction leaves out


@query
def gate_classify_all(m):
    return S.all_signals(m.raw, m.scratch).groupBy("episode_id", "kind", "asks").agg(F.count(F.lit(1)).alias("n"))


@query
def candidate_pairs_all(m):
    return S.all_signals(m.raw, m.scratch).select("reference_id", F.explode("pairs").alias("p")).select("reference_id", "p.slot", "p.value").distinct()


@query
def gate_levels(m):
    levels = [F.count_if(f"keep_{level}").alias(level) for level in ("off", "loose", "pattern", "strict")]
    return S.gate_levels(S.all_signals(m.raw, m.scratch), m.raw).groupBy("episode_id").agg(*levels, F.count(F.lit(1)).alias("turns"))


@query
def gate_confusion_all(m):
    evidence = m.ledger.select(F.explode("evidence").alias("reference_id"))
    return S.confusion(S.gate_levels(S.all_signals(m.raw, m.scratch), m.raw), evidence, ["off", "loose", "pattern", "strict"])


@query
def gate_prevalence_all(m):
    return _prevalence(m, S.all_signals(m.raw, m.scratch))


@query
def i4_extraction_all(m):
    return A.extraction_all(S.all_signals(m.raw, m.scratch), m.ledger)


@query
def normalised_values(m):
    return m.ledger.select("fact_id", T.letters_digits(F.col("value")).alias("key"), T.normal_value(F.col("value")).alias("plain"))


@query
def cleaned_slots(m):
    """Slot names as users write them, cleaned; values without function words around them."""
    return m.ledger.select(F.coalesce("slot", F.lit("")).alias("slot"), F.coalesce("value", F.lit("")).alias("value")).distinct().select("slot", "value", T.clean_slot(F.col("slot")).alias("clean_slot"), T.clean_value(F.col("value")).alias("clean_value"))


@query
def slot_values(m):
    """What the text of a summary says of each slot that its fact keys name."""
    keys = m.summaries.filter(F.col("text").isNotNull()).select("summary_id", "text", F.explode("fact_keys").alias("key")).select("summary_id", "text", T.split_pair(F.col("key")).alias("p")).filter(F.col("p").isNotNull())
    return keys.select("summary_id", F.lower("p.slot").alias("slot"), T.slot_value(F.col("text"), F.col("p.slot")).alias("value")).distinct()


@query
def override_whitelist(m):
    """Override ids that a summary's text gives, and those of them that its episode has."""
    said = m.summaries.filter(F.col("text").isNotNull()).select("summary_id", "episode_id", F.posexplode(T.summary_overrides(F.col("text"))).alias("n", "ref"))
    name = F.substring_index("summary_id", "/", -1)
    known = m.summaries.select("episode_id", name.alias("ref"), F.lit(True).alias("_known")).distinct()
    both = said.join(known, ["episode_id", "ref"], "left")
    return both.groupBy("summary_id").agg(F.count(F.lit(1)).alias("given"), F.countDistinct(F.when(F.col("_known"), F.col("ref"))).alias("accepted"), F.count_if(F.col("_known").isNull()).alias("invalid"))


@query
def question_overlap(m):
    asked = m.probes.filter(F.col("question").isNotNull() & F.col("prediction").isNotNull())
    return asked.select("run_id", "system", "episode_id", "probe_index", F.floor(T.word_overlap(F.col("question"), F.col("prediction")) * 1000).cast("int").alias("overlap_permille"), T.slots_match(F.col("fact_key"), F.col("question")).alias("names_slot"))


@query
def question_slots(m):
    """Slot and anchor that each question asks about, and whether the slot is the probe's own."""
    asked = m.probes.filter(F.col("question").isNotNull()).select("question", "fact_key").distinct()
    q = T.question_slot(F.col("question"))
    return asked.select("question", F.coalesce("fact_key", F.lit("")).alias("fact_key"), q["slot"].alias("slot"), q["anchor"].alias("anchor"), F.coalesce(T.slots_match(q["slot"], F.col("fact_key")), F.lit(False)).alias("same"))


@query
def judge_words(m):
    """What a judge's words say, read from the reasons as they stand."""
    read = F.coalesce(T.judged(F.col("judge_reason")).cast("string"), F.lit("nothing"))
    return m.probes.groupBy(F.coalesce("judge_reason", F.lit("")).alias("reason"), read.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query
def rendered_lines(m):
    """The lines that an answering model is shown: summaries with the ids they override, index entries with their span."""
    ids = F.array_join(F.transform("override_ids", lambda i: T.short_id(i)), ",")
    tag = F.when(ids == "", "none").otherwise(ids)
    chain = R.unfiled(m.active, m.entries).select("episode_id", F.col("summary_id").alias("id"), F.concat(F.lit("- "), T.short_id(F.col("summary_id")), F.lit(" [OVERRIDES: "), F.coalesce(tag, F.lit("none")), F.lit("] "), F.coalesce("text", F.lit(""))).alias("line"))
    span = F.concat(F.lit("turns "), F.coalesce(F.col("turn_start").cast("string"), F.lit("?")), F.lit("-"), F.coalesce(F.col("turn_end").cast("string"), F.lit("?")))
    titles = m.entries.select("episode_id", F.col("index_id").alias("id"), F.concat(F.lit("* "), T.short_id(F.col("index_id")), F.lit(" ("), span, F.lit(") "), F.coalesce(F.substring("title", 1, 120), F.lit(""))).alias("line"))
    return chain.unionByName(titles)


@query
def self_written(m):
    """Replies that hold an update: what is left as the answer, the update's body and its facts."""
    parts = T.self_written(F.col("prediction"))
    held = m.probes.filter(F.lower("prediction").contains("<memory_update>")).select("prediction").distinct()
    split = held.select("prediction", parts["answer"].alias("answer"), parts["update"].alias("update_text"))
    return split.select("prediction", "answer", T.summary_body(F.col("update_text")).alias("body"), F.array_join(T.summary_facts(F.col("update_text")), ";").alias("facts"))


# --- evaluation ---


@query
def string_match_score(m):
    rows = S.scored(m.probes)
    return rows.groupBy("system", "probe_type", "judge_method").agg(F.count_if("matched").alias("matched"), F.count_if(F.col("correct") == 1).alias("judged"), F.count(F.lit(1)).alias("n"))


@query
def metrics_by_system(m):
    return S.metrics(m.probes)


@query
def error_breakdown(m):
    return S.breakdown(m.probes)


@query
def per_episode_accuracy(m):
    return S.per_episode(m.probes)


@query
def runs_union(m):
    """Metrics of every run beside those of all runs, by grouping sets."""
    return m.probes.cube("system", "probe_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("correct", F.lit(0))).alias("correct_n")).select(F.coalesce("system", F.lit("*")).alias("system"), F.coalesce("probe_type", F.lit("*")).alias("probe_type"), "n", "correct_n")


@query
def resume_union(m):
    """Per system and episode the stored payload of the nightly run where it has one, else what is still to do."""
    stored = m.probes.filter(F.col("run_id") == "run-nightly").groupBy("system", "episode_id").agg(F.count(F.lit(1)).alias("probes"), F.sum(F.coalesce("correct", F.lit(0))).alias("correct"), F.lit("done").alias("state"))
    work = m.probes.select("system", "episode_id").distinct()
    todo = work.join(stored.select("system", "episode_id"), ["system", "episode_id"], "left_anti").select("system", "episode_id", F.lit(0).cast("bigint").alias("probes"), F.lit(0).cast("bigint").alias("correct"), F.lit("pending").alias("state"))
    return stored.unionByName(todo)


@query
def validated_intake(m):
    """Facts handed in, per episode: rejected (slot, value or summary blank), accepted, of these added or held already (by summary and slot)."""
    bare = lambda c: T.strip(F.coalesce(F.col(c), F.lit("")))
    given = m.handed.filter(F.col("episode_id").isNotNull()).select("episode_id", bare("slot").alias("slot"), bare("value").alias("value"), bare("summary_id").alias("summary_id"))
    good = (F.col("slot") != "") & (F.col("value") != "") & (F.col("summary_id") != "")
    marked = given.withColumn("ok", good).withColumn("fact_id", F.concat("summary_id", F.lit("#"), "slot"))
    counts = marked.groupBy("episode_id").agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))
    fresh = marked.filter("ok").select("episode_id", "fact_id").distinct().join(m.stored.select("fact_id").filter(F.col("fact_id").isNotNull()).distinct(), "fact_id", "left_anti")
    added = fresh.groupBy("episode_id").agg(F.count(F.lit(1)).alias("added"))
    both = counts.join(added, "episode_id", "left").withColumn("added", F.coalesce("added", F.lit(0)))
    return both.select("episode_id", "accepted", "rejected", "added", (F.col("accepted") - F.col("added")).alias("duplicates"))


def _shapes(m, rows, shapes, name):
    """The rows written as JSON lines, each in one of the shapes that the readers know, and read back as records."""
    body = F.lit(None).cast("string")
    for k, shape in enumerate(shapes):
        body = F.when(F.pmod(F.xxhash64(name), F.lit(len(shapes))) == k, F.to_json(shape)).otherwise(body)
    path = f"{m.scratch.root}/{name}.jsonl"
    rows.select(body.alias("value")).write.text(path)
    return E.read_records(rows.sparkSession, path)


@query
def loaded_turns(m):
    """The raw records as files of dialogues in eight shapes, read back."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    pair = lambda a, b: F.array(F.struct(text("user_msg").alias(a), text("agent_msg").alias(b)))
    said = F.array(F.struct(F.lit("user").alias("role"), text("user_msg").alias("content")), F.struct(F.lit("ai").alias("role"), text("agent_msg").alias("content")))
    own = F.col("reference_id")
    shapes = [
        F.struct(own.alias("episode_id"), F.array(F.array(text("user_msg"), text("agent_msg"))).alias("dialogues")),
        F.struct(own.alias("session_id"), pair("user_input", "agent_output").alias("conversation")),
        F.struct(own.alias("uid"), pair("role_user", "role_assistant").alias("turns")),
        F.struct(own.alias("id"), pair("human", "assistant").alias("history")),
        F.struct(own.alias("sample_id"), pair("question", "answer").alias("messages")),
        F.struct(own.alias("episode_id"), pair("input", "output").alias("sessions")),
        F.struct(own.alias("id"), F.array().cast("array<string>").alias("dialogues"), pair("user_msg", "agent_msg").alias("dialogue")),
        F.struct(own.alias("uid"), F.array(F.struct(said.alias("messages"))).alias("conversations")),
    ]
    return E.turns(E.episodes(_shapes(m, m.raw, shapes, "reference_id")))


@query
def loaded_probes(m):
    """The probes of the nightly run and all others as files in five shapes, read back."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    name = F.concat_ws("|", "run_id", "system", "episode_id", F.col("probe_index").cast("string"))
    rows = m.probes.filter(text("question") != "").select(name.alias("name"), "probe_type", "fact_key", "question", "gold")
    one = lambda *cols: F.array(F.struct(*cols))
    label = F.when(F.col("probe_type") == "history_fact", "overridden").when(F.col("probe_type") == "current_fact", "latest").when(F.col("probe_type") == "memory_point", "lookup").otherwise(F.col("probe_type"))
    shapes = [
        F.struct(F.col("name").alias("id"), one(F.col("question"), text("gold").alias("answer"), F.col("probe_type").alias("type"), text("fact_key").alias("fact_key")).alias("probes")),
        F.struct(F.col("name").alias("uid"), one(F.col("question").alias("query"), text("gold").alias("target"), label.alias("category"), text("fact_key").alias("entity")).alias("test_questions")),
        F.struct(F.col("name").alias("session_id"), one(F.col("question").alias("q"), F.array(text("gold"), F.lit("other")).alias("expected"), label.alias("probe_type"), text("fact_key").alias("key")).alias("qa")),
        F.struct(F.col("name").alias("id"), F.array("question").alias("queries")),
        F.struct(F.col("name").alias("id"), F.col("question"), text("gold").alias("label"), F.col("probe_type").alias("type"), text("fact_key").alias("fact_key")),
    ]
    return E.probes(E.episodes(_shapes(m, rows, shapes, "name")))


@query
def dataset_inspect(m):
    turns = m.raw.filter(F.col("turn_index").isNotNull()).groupBy("episode_id").agg(F.count(F.lit(1)).alias("turns"))
    asked = m.probes.groupBy("episode_id").agg(F.countDistinct("probe_index").alias("probes"))
    return turns.join(asked, "episode_id", "left").agg(F.count(F.lit(1)).alias("episodes"), F.sum("turns").alias("turns"), F.max("turns").alias("most_turns"), F.sum("probes").alias("probes"), F.count_if(F.col("probes").isNull()).alias("without_probes"))


@query
def turn_pairs(m):
    """Messages put back into (user, agent) pairs: a pair starts at a user message, and at an agent message that follows none.

    The turns of an episode are read as one stream of messages; neighbours are found by their ordinals.
    """
    sides = F.array(F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("user_msg").alias("text")), F.struct(F.lit(1).alias("k"), F.lit("agent").alias("role"), F.col("agent_msg").alias("text")))
    one = m.raw.filter(F.col("turn_index").isNotNull()).groupBy("episode_id", "turn_index").agg(F.max(F.struct("ts", "reference_id", "user_msg", "agent_msg")).alias("r")).select("episode_id", "turn_index", "r.user_msg", "r.agent_msg")
    said = one.select("episode_id", "turn_index", F.explode(sides).alias("s")).filter(F.coalesce("s.text", F.lit("")) != "")
    said = said.select("episode_id", (F.col("turn_index") * 2 + F.col("s.k")).alias("at"), "s.role")
    seen = L.previous_in_order(said, ["episode_id"], "at", "role", "before")
    starts = seen.filter((F.col("role") == "user") | (F.coalesce("before", F.lit("")) != "user"))
    return starts.groupBy("episode_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("role") == "agent").alias("orphans"))


@query
def time_labels(m):
    return m.entries.select("index_id", F.when(F.col("turn_start") == F.col("turn_end"), F.concat(F.lit("turn "), F.col("turn_start").cast("string"))).otherwise(F.concat(F.lit("turn "), F.col("turn_start").cast("string"), F.lit("-"), F.col("turn_end").cast("string"))).alias("label"), F.substring("title", 1, 120).alias("title"))


def supersede_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Every summary that reaches a root with all its successors, archive and active layer alike, by distance."""
    tree = forests(spark, folder).filter(F.startswith("id", F.lit("summary\t")) & (F.col("depth") >= 0))
    near = expand_paths(tree)
    deep = tree.select("id", F.col("depth").alias("_own"))
    walk = near.join(deep, "id").filter(F.col("id") != F.col("ancestor"))
    bare = lambda c: F.substring_index(c, "\t", -1)
    return walk.select(bare("id").alias("summary_id"), bare("ancestor").alias("successor"), (F.col("_own") - F.col("depth")).cast("int").alias("steps"))


QUERIES["supersede_chain"] = supersede_chain


# --- functions without SQL ---


@query
def truncated_texts(m):
    """Documents cut to 128 estimated tokens."""
    return m.documents.select("doc_id", U.truncate_to_tokens(F.col("text"), 128).alias("text"))


@query
def tool_calls(m):
    """Calls that predictions and documents hold, as they stand in them."""
    said = m.probes.select(F.lit("prediction").alias("src"), F.concat_ws("|", "run_id", "system", "episode_id", F.col("probe_index").cast("string")).alias("key"), F.col("prediction").alias("text"))
    both = said.unionByName(m.documents.select(F.lit("document").alias("src"), F.col("doc_id").cast("string").alias("key"), "text"))
    return both.select("src", "key", F.posexplode(U.tool_calls(F.col("text"))).alias("n", "c")).select("src", "key", "n", "c.name", "c.args")
