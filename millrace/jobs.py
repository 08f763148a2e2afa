"""The job catalogue: idempotent submit, conditional cancel, status, listing, runs and results.

A job is a folder, named by its identity, with job.json (its state, replaced as a whole) and, once it has succeeded, the
sealed results. A client's requests carry sequence numbers; the last one's answer is kept, so that a retry gets it again.
"""

from __future__ import annotations

import hashlib
import json
import threading

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from millrace import results, streaming
from millrace.errors import CapacityExhausted, CorruptResult, IdentityReuse, InvalidTransition, LimitExceeded, MillraceError, NotFound, RequestError, ResultUnavailable, SkippedRequest, StaleRequest
from millrace.functions import identity
from millrace.limits import DEFAULT, Limits
from millrace.plans import planner, spec
from millrace.plans.validate import Validated, validate
from millrace.store import Store

TERMINAL = ("succeeded", "failed", "canceled")
NEXT = {"pending": "deploying", "deploying": "running", "running": "draining", "draining": "succeeded"}
OPERATOR_FAILURE, STORAGE_FAILURE = 1, 3
#: Spark's names of errors that a row made an operator raise.
_OF_ROWS = ("ARITHMETIC_OVERFLOW", "USER_RAISED_EXCEPTION")


def failure_code(error: BaseException) -> int:
    """OPERATOR_FAILURE for what a row or the graph caused, STORAGE_FAILURE for all else."""
    own = isinstance(error, MillraceError) and not isinstance(error, CorruptResult)
    return OPERATOR_FAILURE if own or (isinstance(error, PySparkException) and any(x in str(error) for x in _OF_ROWS)) else STORAGE_FAILURE


class Catalogue:
    """Jobs below a folder. One driver at a time changes a catalogue."""

    def __init__(self, spark: SparkSession, root: str, limits: Limits = DEFAULT):
        self.spark, self.root, self.limits = spark, root.rstrip("/"), limits
        self.store = Store(spark, self.root)
        self._lock = threading.RLock()
        self._verified: set[str] = set()

    # ------------------------------------------------------------------------------------------------------- records

    def _load(self, job: str) -> dict:
        if not self.store.exists(f"jobs/{job}/job.json"):
            raise NotFound(f"no job {job}")
        return json.loads(self.store.read(f"jobs/{job}/job.json"))

    def _save(self, record: dict) -> None:
        self.store.write(f"jobs/{record['job_id']}/job.json", json.dumps(record), replace=True)

    def _records(self) -> list[dict]:
        return [self._load(job) for job in self.store.names("jobs")]

    def _graph(self, record: dict) -> Validated:
        return validate(spec.decode(bytes.fromhex(record["topology"]), self.limits), self.limits)

    def _request(self, client: bytes, sequence: int, digest: str, act) -> dict:
        """act() at the client's next sequence number; its answer again at the last one."""
        if len(client) != 16 or not any(client) or sequence < 1:
            raise RequestError("a request has a client id of 16 bytes that are not all 0, and a sequence number from 1")
        name = f"clients/{client.hex()}.json"
        with self._lock:
            last = json.loads(self.store.read(name)) if self.store.exists(name) else {"sequence": 0}
            if sequence == last["sequence"]:
                if digest != last["digest"]:
                    raise IdentityReuse("this sequence number was another request's")
                return last["answer"]
            if sequence < last["sequence"]:
                raise StaleRequest("the sequence number is below the last one")
            if sequence > last["sequence"] + 1:
                raise SkippedRequest("the sequence number is not the next one")
            answer = act()
            self.store.write(name, json.dumps({"sequence": sequence, "digest": digest, "answer": answer}), replace=True)
            return answer

    # ------------------------------------------------------------------------------------------------------ commands

    def submit(self, document: str | bytes | spec.Topology, client: bytes, sequence: int) -> dict:
        topology = document if isinstance(document, spec.Topology) else spec.parse(document, self.limits)
        graph = validate(topology, self.limits)
        digest = graph.digest()
        job = identity.job_id(client, sequence, digest).hex()

        def act() -> dict:
            records = self._records()
            active = sum(r["state"] not in TERMINAL for r in records)
            if len(records) >= self.limits.retained_jobs or active >= self.limits.active_jobs:
                raise CapacityExhausted("too many jobs")
            record = {
                "job_id": job, "state": "pending", "job_control_revision": 1, "topology": topology.canonical().hex(), "topology_digest": digest.hex(),
                "source_task_count": graph.source.parallelism, "completed_source_tasks": 0, "result_partition_count": graph.sink.parallelism,
                "manifest_count": 0, "manifest_set_digest": "", "failure_code": None, "failure": "",
            }
            self.store.write(f"jobs/{job}/job.json", json.dumps(record))
            return {"command": "submit", "job_id": job, "job_control_revision": 1, "state": "pending"}

        return self._request(client, sequence, f"submit:{digest.hex()}", act)

    def cancel(self, job: str, expected_revision: int, client: bytes | None = None, sequence: int = 0) -> dict:
        def act() -> dict:
            record = self._load(job)
            if record["state"] == "canceled" and record["job_control_revision"] == expected_revision + 1:
                return self._canceled(record)
            if record["state"] in TERMINAL or record["job_control_revision"] != expected_revision:
                raise InvalidTransition(f"the job is {record['state']} at revision {record['job_control_revision']}")
            record["state"], record["job_control_revision"] = "canceled", expected_revision + 1
            self._save(record)
            self.spark.sparkContext.cancelJobGroup(job)
            return self._canceled(record)

        with self._lock:
            if client is None:
                return act()
            return self._request(client, sequence, hashlib.sha256(f"cancel:{job}:{expected_revision}".encode()).hexdigest(), act)

    @staticmethod
    def _canceled(record: dict) -> dict:
        return {"command": "cancel", "job_id": record["job_id"], "job_control_revision": record["job_control_revision"], "state": "canceled"}

    def _advance(self, job: str, state: str, **more) -> dict:
        with self._lock:
            record = self._load(job)
            if record["state"] in TERMINAL or (state != "failed" and NEXT[record["state"]] != state):
                raise InvalidTransition(f"a job that is {record['state']} can't become {state}")
            record |= {"state": state} | more
            self._save(record)
            return record

    def _progressed(self, job: str, completed: int) -> None:
        with self._lock:
            record = self._load(job)
            if record["state"] == "running":
                self._save(record | {"completed_source_tasks": completed})

    def run(self, job: str, stream: bool = False) -> dict:
        """Runs a pending job to its end, as a batch or as a stream that shows its progress in the status. A row that an
        operator refuses makes it fail; nothing of it becomes visible. Whatever else ends a run also makes it fail (with
        the code of storage), and is raised."""
        graph = self._graph(self._advance(job, "deploying"))
        context = self.spark.sparkContext
        context.setJobGroup(job, graph.topology.name, True)
        try:
            if stream:
                self._advance(job, "running")
                found = streaming.run_sealed(self.spark, graph, bytes.fromhex(job), f"{self.root}/jobs/{job}", limits=self.limits, told=lambda done: self._progressed(job, done))
            else:
                rows = planner.compile_graph(self.spark, graph, bytes.fromhex(job), limits=self.limits)
                self._advance(job, "running")
                found = results.seal(rows, f"{self.root}/jobs/{job}/results", graph.sink.parallelism, limits=self.limits)
            self._advance(job, "draining", completed_source_tasks=graph.source.parallelism)
            self._advance(job, "succeeded", manifest_count=graph.sink.parallelism, manifest_set_digest=found.digest)
        except InvalidTransition:  # it was canceled meanwhile
            self.store.delete(f"jobs/{job}/results")
        except BaseException as error:
            if self._load(job)["state"] not in TERMINAL:
                self._advance(job, "failed", failure_code=failure_code(error), failure=str(error)[:2000])
                self.store.delete(f"jobs/{job}/results")
                if failure_code(error) != OPERATOR_FAILURE:
                    raise
            elif not isinstance(error, (PySparkException, MillraceError)):  # a job that was canceled meanwhile ends so
                raise
        finally:
            context._jsc.sc().clearJobGroup()
        return self.status(job)

    # ------------------------------------------------------------------------------------------------------- queries

    @staticmethod
    def _summary(record: dict) -> dict:
        shown = ("job_id", "state", "job_control_revision", "topology_digest", "source_task_count", "completed_source_tasks", "result_partition_count", "manifest_count", "manifest_set_digest")
        out = {k: record[k] for k in shown} | {"has_failure": record["failure_code"] is not None}
        return out | ({"failure_code": record["failure_code"]} if out["has_failure"] else {})

    def status(self, job: str) -> dict:
        return {"command": "status"} | self._summary(self._load(job))

    def jobs(self) -> dict:
        return {"command": "jobs", "jobs": [self._summary(r) for r in self._records()]}

    def overview(self) -> dict:
        """All jobs and how many are in each state, as one document."""
        own = self.jobs()["jobs"]
        return {"jobs": own, "states": {s: sum(j["state"] == s for j in own) for s in (*NEXT, *TERMINAL)}}

    def results(self, job: str, digest: str | None = None) -> results.ResultSet:
        """The job's sealed results, which this catalogue has verified once."""
        record = self._load(job)
        if not record["manifest_set_digest"]:
            raise ResultUnavailable(f"job {job} has no complete results")
        found = results.open_results(self.spark, f"{self.root}/jobs/{job}/results", digest or record["manifest_set_digest"])
        if found.digest not in self._verified:
            results.verify(found, self.limits)
            self._verified.add(found.digest)
        return found

    def sink_stage(self, job: str) -> int:
        return self._graph(self._load(job)).sink.stage_id


__all__ = ["Catalogue", "LimitExceeded", "NEXT", "TERMINAL"]
