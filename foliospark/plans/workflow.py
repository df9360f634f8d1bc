"""Whole runs: from archives to Markdown, and from a checkpoint on; each stage is a table below an output folder."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ContentError
from ..operators import content, formula_audit, render, table_rounds, tasks, translate
from ..session import materialise
from ..sources import content as sources
from ..sources import sinks


@dataclass
class Services:
    """The plug-ins of a run."""

    translator: translate.Translator = field(default_factory=translate.UppercaseTranslator)
    validator: formula_audit.Validator = formula_audit.structural_validator
    max_retries: int = 1
    concurrency: int = 5
    timeout_s: float | None = 600.0


@dataclass
class StageLog:
    """What each stage did: (stage, status, seconds, error)."""

    rows: list[tuple[str, str, float, str | None]] = field(default_factory=list)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        except Exception as e:
            self.rows.append((name, "failed", time.perf_counter() - began, str(e)[:2000]))
            raise
        self.rows.append((name, "finished", time.perf_counter() - began, None))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "stage string, status string, seconds double, error string")


def _none(bad: DataFrame, what: str) -> None:
    first = bad.head()
    if first is not None:
        raise ContentError(f"{what}: {first.asDict()}")


def _stored(df: DataFrame, path: str) -> DataFrame:
    sinks.write_stage(df, path, by_document=True)
    return sinks.read_stage(df.sparkSession, path)


def _replacing(docs: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
    """As _stored, for rows of docs(doc_id) that take the place of those that the table has of them; gives back these rows alone. A table that isn't there is begun."""

    def put(df: DataFrame, path: str) -> DataFrame:
        new = materialise(df, "update")
        if sinks.read_stage(df.sparkSession, path) is None:
            sinks.write_stage(new, path, by_document=True)
        else:
            sinks.replace_documents(new, docs, path)
        return new

    return put


def _there(spark: SparkSession, path: str) -> DataFrame:
    found = sinks.read_stage(spark, path)
    if found is None:
        raise ContentError(f"{path}: no finished stage")
    return found


def ensure_audit(items: DataFrame, out: str, services: Services) -> DataFrame:
    """The audit records below out: those that are there if they are current and consistent, new ones if they are of version 1 or were never written. Current ones that contradict themselves, version 1 ones that do, and records that can't be read are errors, and nothing is written over them."""
    known = sinks.read_stage(items.sparkSession, f"{out}/formula_audit")
    if known is not None:
        version = formula_audit.report_version(known.columns)
        _none(formula_audit.record_errors(known) if version == 2 else formula_audit.legacy_record_errors(known), "a formula record contradicts itself")
        if version == 2:
            return known
    return write_audit(items, f"{out}/content", f"{out}/formula_audit", services)


def write_audit(items: DataFrame, source: str, target: str, services: Services) -> DataFrame:
    """The audit of items, stored at target. target must not be the folder that the items come from, nor lie above or in it."""
    a, b = (x.rstrip("/") + "/" for x in (source, target))
    if a.startswith(b) or b.startswith(a):
        raise ContentError("an audit must not overwrite its source")
    return _stored(formula_audit.audit(formula_audit.scan_items(items), services.validator), target)


def normalise(items: DataFrame, out: str, log: StageLog, put: Callable[[DataFrame, str], DataFrame] = _stored) -> DataFrame:
    """Cleaned and merged items; candidates are checked before they are used, and kept."""
    with log.stage("clean"):
        cleaned = put(content.clean(items), f"{out}/cleaned")
    with log.stage("cross_page"):
        found = put(content.cross_page_candidates(cleaned), f"{out}/cross_page_candidates")
    with log.stage("merge"):
        _none(content.candidate_errors(cleaned, found), "a candidate cannot be merged")
        return put(content.merge_cross_pages(cleaned, found), f"{out}/normalized")


def _translate(states: DataFrame, auxiliary: DataFrame, out: str, services: Services) -> DataFrame:
    units = translate.work_units(states, auxiliary)
    how = services.translator, services.max_retries, services.concurrency, services.timeout_s
    open_tables = f"{out}/table_answers"  # those of a run that died before its end are used
    done = translate.run_units(units.filter("kind <> 'table'"), *how).unionByName(table_rounds.run_tables(units, open_tables, *how))
    sinks.append_outcomes(done.withColumn("written_at", F.current_timestamp()), f"{out}/outcomes")
    sinks.remove(states.sparkSession, open_tables)
    own = states.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    newest = sinks.newest_outcomes(sinks.read_outcomes(states.sparkSession, f"{out}/outcomes").join(own, "doc_id", "left_semi"))
    _none(translate.left_pending(translate.apply_outcomes(states, newest)), "work was left undone")
    return newest


def _render(outcomes: DataFrame, records: DataFrame, out: str, states: DataFrame, put: Callable[[DataFrame, str], DataFrame] = _stored) -> DataFrame:
    done = put(translate.apply_outcomes(states, outcomes), f"{out}/translated")
    fixed = formula_audit.replacement_lists(formula_audit.accepted_replacements(records))
    aux = outcomes.filter("kind = 'auxiliary' and status = 'success'").select("doc_id", "item_index", "field", "pos", "translated")
    return put(render.render(done, fixed, aux), f"{out}/markdown")


def process(members: DataFrame, out: str, services: Services | None = None, log: StageLog | None = None) -> DataFrame:
    """doc_id, markdown from the members of archives. The audit reads the items before cleaning; a failing stage ends the run and leaves the tables of those before it."""
    services, log = services or Services(), log or StageLog()
    with log.stage("extract"):
        items = _stored(sources.archive_items(members), f"{out}/content")
    with log.stage("audit"):
        records = ensure_audit(items, out, services)
    return _finish(items, records, out, services, log, _stored)


def _finish(items: DataFrame, records: DataFrame, out: str, services: Services, log: StageLog, put: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    normalized = normalise(items, out, log, put)
    with log.stage("translate"):
        states = translate.new_states(normalized)
        outcomes = _translate(states, translate.auxiliary_units(normalized), out, services)
    with log.stage("render"):
        return _render(outcomes, records, out, states, put)


def update(members: DataFrame, out: str, services: Services | None = None, log: StageLog | None = None) -> DataFrame:
    """doc_id, markdown of the documents of these archives alone, new or changed ones, after a run at out. Their rows are replaced or added in every table there, audit and checkpoints too; of the other documents nothing is read or written but what shares a bucket with one of them."""
    services, log = services or Services(), log or StageLog()
    docs = materialise(members.select("doc_id").distinct(), "documents")
    put = _replacing(docs)
    with log.stage("extract"):
        items = put(sources.archive_items(members), f"{out}/content")
    with log.stage("audit"):
        records = put(formula_audit.audit(formula_audit.scan_items(items), services.validator), f"{out}/formula_audit")
    return _finish(items, records, out, services, log, put)


def resume(spark: SparkSession, out: str, services: Services | None = None, log: StageLog | None = None) -> DataFrame:
    """doc_id, markdown from the normalized items below out, translating only what hasn't succeeded. A checkpoint that doesn't fit the items is an error and stays as it is."""
    services, log = services or Services(), log or StageLog()
    normalized = _there(spark, f"{out}/normalized")
    sinks.compact_appended(spark, f"{out}/outcomes")
    with log.stage("audit"):
        records = ensure_audit(_there(spark, f"{out}/content"), out, services)
    with log.stage("translate"):
        stored = _there(spark, f"{out}/translated")
        _none(translate.resume_errors(normalized, stored), "the checkpoint does not fit")
        states = _stored(translate.resume_states(normalized, stored), f"{out}/resumed")
        outcomes = _translate(states, translate.auxiliary_units(normalized), out, services)
    with log.stage("render"):
        return _render(outcomes, records, out, states)


def run_next(task_table: DataFrame, run: Callable[[str], tuple[str, str]]) -> tuple[DataFrame, str | None]:
    """(tasks, id) after running the oldest queued task with run(id) -> (normalized path, Markdown path); its failure is the task's state, not an error here."""
    now = F.current_timestamp()
    claimed, task_id = tasks.claim_next(task_table, now)
    if task_id is None:
        return task_table, None
    return _finished(claimed, task_id, run), task_id


def _finished(claimed: DataFrame, task_id: str, run: Callable[[str], tuple[str, str]]) -> DataFrame:
    now = F.current_timestamp()
    try:
        normalized, markdown = run(task_id)
    except Exception as e:  # the task's failure
        return tasks.fail(claimed, task_id, str(e) or type(e).__name__, now)
    return tasks.succeed(claimed, task_id, normalized, markdown, now)


def work(spark: SparkSession, path: str, run: Callable[[str], tuple[str, str]], stopped: Callable[[], bool], wait_s: float = 1.0) -> int:
    """Runs the tasks of the table at path (see sinks.write_stage) one at a time, the oldest first, until stopped() says so, and returns how many. One driver works on a table.

    What was running when the last worker ended is interrupted at the start and can be resumed. A claim is
    stored before its task runs and the outcome after it, so a worker that dies leaves a running task; a
    task that fails doesn't end the worker. Without a queued task it looks again after wait_s.
    """
    sinks.write_stage(tasks.interrupt_running(_there(spark, path), F.current_timestamp()), path)
    n = 0
    while not stopped():
        claimed, task_id = tasks.claim_next(_there(spark, path), F.current_timestamp())
        if task_id is None:
            time.sleep(wait_s)
            continue
        sinks.write_stage(claimed, path)
        sinks.write_stage(_finished(_there(spark, path), task_id, run), path)
        n += 1
    return n


def cross_page_report(cleaned: DataFrame) -> DataFrame:
    """Candidates with the section numbers (among texts, from 1) and array numbers (from 1) of both sides."""
    numbers = content.section_numbers(cleaned).select("doc_id", F.col("item_index").alias("i"), "section_number")
    found = content.cross_page_candidates(cleaned)
    first = numbers.withColumnsRenamed({"i": "previous_index", "section_number": "previous_section"})
    second = numbers.withColumnsRenamed({"i": "next_index", "section_number": "next_section"})
    out = found.join(first, ["doc_id", "previous_index"]).join(second, ["doc_id", "next_index"])
    return out.withColumns({"previous_number": F.col("previous_index") + 1, "next_number": F.col("next_index") + 1})


def stats_text(stats: DataFrame) -> DataFrame:
    """doc_id, text: the counters of a translation in a few lines."""
    line = lambda name, *cols: F.concat(F.lit(f"{name}: "), F.concat_ws(", ", *(F.concat(F.lit(f"{c.rsplit('_count', 1)[0]} "), F.col(c).cast("string")) for c in cols)))
    return stats.select(
        "doc_id",
        F.concat_ws(
            "\n",
            line("calls", "model_call_count", "text_model_call_count", "table_model_call_count", "auxiliary_model_call_count"),
            line("texts", "text_count", "success_count", "failed_count", "pending_count", "skipped_success_count"),
            line("tables", "table_count", "table_success_count", "table_partial_success_count", "table_failed_count", "table_skipped_count"),
            line("captions", "auxiliary_count", "auxiliary_success_count", "auxiliary_failed_count", "auxiliary_pending_count"),
        ).alias("text"),
    )
