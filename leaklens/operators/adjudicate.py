"""The scoring seam: plan calls, run a scorer on the workers, parse its answers, merge verdicts, review discoveries.

A scorer is any callable of one prompt string that returns the model's answer text, or that and why it ended; it runs in ``mapInArrow`` tasks, so
a repeated task may repeat its calls: answers are keyed by (request_id, batch_id) and written once before they are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from .detect import short_circuit, truncated
from .locate import fill_gaps, merge_response
from .packing import body, pack_findings

Scorer = Callable[[str], str | tuple[str, str]]

VERDICTS = "array<struct<finding_id:string,verdict:string,confidence:double,reason:string>>"
CANDIDATES = "array<struct<source_id:string,value:string,kind:string,confidence:double,reason:string>>"


def unfenced(answer):
    """Without a code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(answer), r"\A```[^\n]*\n?", ""), r"\s*```\s*\z", "")


def parse_verdicts(answers: DataFrame) -> DataFrame:
    """request_id, batch_id, ord, finding_id, verdict, confidence, reason, error: an envelope or a bare array; else one error row."""
    return _parsed(answers, VERDICTS, "verdicts")


def parse_candidates(answers: DataFrame) -> DataFrame:
    """As verdicts, for candidates; an empty answer is no candidates, and blank values without a source are dropped."""
    got = _parsed(answers, CANDIDATES, "candidates")
    return got.where("error OR source_id IS NOT NULL OR trim(value) <> ''")


def _parsed(answers: DataFrame, item: str, name: str) -> DataFrame:
    a = unfenced(F.col("answer"))
    arr = F.when(F.startswith(a, F.lit("[")), F.from_json(a, item)).when(F.startswith(a, F.lit("{")), F.from_json(a, f"struct<{name}:{item}>")[name])
    if name == "candidates":
        arr = F.when(a == "", F.from_json(F.lit("[]"), item)).otherwise(arr)
    x = answers.withColumn("items", arr)
    return x.select("request_id", "batch_id", F.posexplode_outer("items").alias("pos", "v"), F.isnull("items").alias("error")).select(
        "request_id", "batch_id", (F.col("batch_id").cast("long") * 1_000_000 + F.coalesce("pos", F.lit(0))).alias("ord"), "v.*", "error"
    ).where(F.col("error") | F.col("ord").isNotNull())


def well_formed(answer: str, name: str) -> bool:
    """Whether an answer is a JSON array, or an object (with the list ``name`` or without), of the shape to be parsed. No candidates are an answer."""
    import json
    import re

    body = re.sub(r"\s*```\s*\Z", "", re.sub(r"\A```[^\n]*\n?", "", answer.strip()))
    if not body and name == "candidates":
        return True
    try:
        got = json.loads(body)
    except ValueError:
        return False
    return isinstance(got, list) or isinstance(got, dict) and isinstance(got.get(name, []), list)


def call(prompts: DataFrame, scorer: Scorer, name: str = "verdicts") -> DataFrame:
    """request_id, batch_id, answer, attempts, failure for prompts (request_id, batch_id, prompt).

    A scorer gives a text, or a text and why it ended. One that is malformed or cut short (``length``), and an exception,
    is tried once more, from scratch and with a note; a refused one (``content_filter``) is not. ``failure`` names what
    went wrong in the end, never what was answered.
    """
    import pyarrow as pa

    def one(prompt: str) -> tuple[str, int, str | None]:
        why = None
        for attempt in (1, 2):
            try:
                got = scorer(prompt if attempt == 1 else f"{prompt}\n{C.RECOVERY_NOTE}")
            except Exception:
                why = "backend error"
                continue
            text, finish = got if isinstance(got, tuple) else (got, "stop")
            if finish == "content_filter":
                return "", attempt, "refused"
            if finish != "length" and well_formed(text or "", name):
                return text or "", attempt, None
            why = "truncated" if finish == "length" else "malformed"
        return "malformed", 2, why

    def run(batches):
        for b in batches:
            got = [one(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.string())], names=["request_id", "batch_id", "answer", "attempts", "failure"])

    return prompts.select("request_id", F.col("batch_id").cast("int").alias("batch_id"), "prompt").mapInArrow(run, "request_id string, batch_id int, answer string, attempts int, failure string")


def tool_answers(calls: DataFrame, tool: str) -> DataFrame:
    """The arguments of the calls of one tool (request_id, batch_id, ord, name, arguments) as answers to parse; other tools do not count."""
    return calls.where(F.col("name") == tool).select("request_id", "batch_id", F.col("arguments").alias("answer"))


def fingerprint(profile: Column, system: Column, user: Column) -> Column:
    """profile:hash, which tells which prompt is live."""
    return F.concat(profile, F.lit(":"), F.substring(F.sha2(F.concat(system.cast("binary"), F.lit(b"\0"), user.cast("binary")), 256), 1, 12))


def prompts_of(packed: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("path", "line", "match", "id", body(F.col("id"), F.col("path"), F.col("line"), F.col("match"), F.col("context")).alias("text"))))
    return packed.groupBy("request_id", "batch_id").agg(F.concat_ws("\n", parts["text"]).alias("prompt"))


def adjudicate(findings: DataFrame, scorer: Scorer, input_tokens: int = 24_000, output_tokens: int = 4096, max_findings: int = 200, max_per_call: int = 0, on_truncate: str = "compat_confirmed", rules: bool = True) -> DataFrame:
    """Findings (with context) with verdict, confidence, reason: cut, fixed rules, batches, scorer, gaps, merge."""
    ranked = truncated(findings, max_findings)
    kept = ranked.where("NOT cut").drop("cut", "rank")
    ruled = short_circuit(kept) if rules else kept.withColumns({"verdict": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "reason": F.lit(None).cast("string")})
    undecided = ruled.where("verdict IS NULL").drop("verdict", "confidence", "reason")
    answers = call(prompts_of(pack_findings(undecided, input_tokens, output_tokens, max_per_call)), scorer)
    model = fill_gaps(undecided, parse_verdicts(answers).where("NOT error"))
    cols = ["request_id", "id", "verdict", "confidence", "reason"]
    return merge_response(findings, ruled.where("verdict IS NOT NULL").select(*cols).unionByName(model.select(*cols)), on_truncate)


def review(discoveries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Discoveries with ``outcome``: confirmed ones keep the reviewer's confidence and reason, dismissed go, others are withheld."""
    from .locate import last_verdicts

    v = last_verdicts(verdicts).select("request_id", F.col("finding_id").alias("id"), F.col("verdict").alias("mv"), F.col("confidence").alias("mc"), F.col("reason").alias("mr"))
    out = discoveries.join(v, ["request_id", "id"], "left")
    keep = [c for c in discoveries.columns if c not in ("confidence", "reason")]
    sure = F.col("mv") == "confirmed"
    return out.select(*keep, F.when(sure, F.col("mc")).otherwise(F.col("confidence")).alias("confidence"), F.when(sure, F.col("mr")).otherwise(F.col("reason")).alias("reason"), F.when(sure, "confirmed").when(F.col("mv") == "dismissed", "dismissed").otherwise("withheld").alias("outcome"))
