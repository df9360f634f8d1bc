"""Outside services as plug-ins: a chat model that translates, a process that validates, a parser that reads files, a store over JDBC.

Objects here are sent to the tasks that use them, so they hold plain values only and connect when they are called.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import subprocess
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, urlencode
from zipfile import is_zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FolioError


class ServiceError(FolioError):
    """A service that can't be reached or doesn't keep its contract."""


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    """A redirect would take the key to another host."""

    def redirect_request(self, *_):
        return None


_OPEN = urllib.request.build_opener(_NoRedirect).open


@dataclass(frozen=True)
class Http:
    """Requests with JSON or bytes to one service."""

    base_url: str
    headers: dict = field(default_factory=dict)
    timeout_s: float = 120.0

    def call(self, method: str, path: str, body: object = None, ok: tuple[int, ...] = (200,), content_type: str = "application/json") -> bytes:
        raw = body if isinstance(body, bytes) or body is None else json.dumps(body, ensure_ascii=False).encode()
        asked = urllib.request.Request(self.base_url.rstrip("/") + path, raw, {**self.headers, **({"Content-Type": content_type} if raw is not None else {})}, method=method)
        try:
            with _OPEN(asked, timeout=self.timeout_s) as answer:
                status, data = answer.status, answer.read()
        except urllib.error.HTTPError as e:
            raise ServiceError(f"{method} {path}: HTTP {e.code}") from None
        except (OSError, ValueError) as e:
            raise ServiceError(f"{method} {path}: {e}") from e
        if status not in ok:
            raise ServiceError(f"{method} {path}: HTTP {status}")
        return data

    def json(self, method: str, path: str, body: object = None, ok: tuple[int, ...] = (200, 202)) -> dict:
        try:
            got = json.loads(self.call(method, path, body, ok))
        except ValueError:
            raise ServiceError(f"{method} {path}: no JSON") from None
        if not isinstance(got, dict):
            raise ServiceError(f"{method} {path}: no JSON object")
        return got


def _bearer(key: str) -> dict:
    return {"Authorization": f"Bearer {key.strip()}"} if key.strip() else {}


PROMPT = "Translate the user's text. Keep every placeholder and every mark-up exactly as it is, each once and in a fitting place. Answer with the translation only."
STRICT = "A former answer changed placeholders. Copy each placeholder of the text to the translation exactly once, without any change, and add no other."


@dataclass(frozen=True)
class ChatTranslator:
    """A translator for run_units over a chat completion service: one request a text, an answer without text is an error. enable_thinking is sent only if it is set."""

    base_url: str
    api_key: str
    model: str
    timeout_s: float = 120.0
    enable_thinking: bool | None = None
    prompt: str = PROMPT
    strict_prompt: str = STRICT

    def __post_init__(self) -> None:
        if not all(x.strip() for x in (self.base_url, self.api_key, self.model)) or not 0 < self.timeout_s < float("inf"):
            raise ValueError("a translator needs an address, a key, a model and a time limit")

    def translate(self, text: str, *, strict: bool = False, response_format: dict | None = None) -> str:
        system = f"{self.prompt}\n\n{self.strict_prompt}" if strict else self.prompt
        asked: dict = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": text}]}
        if self.enable_thinking is not None:
            asked["chat_template_kwargs"] = {"enable_thinking": self.enable_thinking}
        if response_format is not None:
            asked["response_format"] = response_format
        got = Http(self.base_url, _bearer(self.api_key), self.timeout_s).json("POST", "/chat/completions", asked)
        try:
            answer = got["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError):
            raise ServiceError("an answer without choices") from None
        if not isinstance(answer, str) or not answer.strip():
            raise ServiceError("an empty translation")
        return answer


@dataclass(frozen=True)
class ProcessValidator:
    """A validator for audit(): one process for each batch, that reads {version, config, formulas} from its input and writes {version, config, results} with a result for each formula, in order. Another version or configuration, or anything else that breaks this, is an error of the run; formulas don't appear in its text."""

    command: tuple[str, ...]
    version: str
    config: dict = field(default_factory=lambda: {"throwOnError": False, "trust": False, "maxSize": 20, "maxExpand": 500})
    timeout_s: float = 120.0

    def __call__(self, formulas: list[tuple[str, bool]]) -> list[str | None]:
        ids = [f"formula-{n}" for n in range(len(formulas))]
        asked = {"version": self.version, "config": self.config, "formulas": [{"formula_id": i, "formula": f, "is_block": b} for i, (f, b) in zip(ids, formulas, strict=True)]}
        try:
            ran = subprocess.run(self.command, input=json.dumps(asked), text=True, capture_output=True, timeout=self.timeout_s, check=False)
        except (OSError, subprocess.TimeoutExpired) as e:
            raise ServiceError(f"the validator did not run: {type(e).__name__}") from None
        if ran.returncode:
            said = ran.stderr.strip()
            for f in sorted({f for f, _ in formulas if f}, key=len, reverse=True):
                said = said.replace(f, "<formula>")
            raise ServiceError(f"the validator failed: {said[:1000]}")
        try:
            got = json.loads(ran.stdout)
        except ValueError:
            raise ServiceError("the validator gave no JSON") from None
        if not isinstance(got, dict) or set(got) != {"version", "config", "results"} or got["version"] != self.version or got["config"] != self.config:
            raise ServiceError("the validator has another version or configuration")
        results = got["results"]
        if not isinstance(results, list) or [r.get("formula_id") if isinstance(r, dict) and set(r) == {"formula_id", "syntax_status", "validation_error"} else None for r in results] != ids:
            raise ServiceError("the validator's results don't match the formulas")
        for r in results:
            error = r["validation_error"]
            if not (r["syntax_status"] == "valid" and error is None or r["syntax_status"] == "invalid_syntax" and isinstance(error, str) and error):
                raise ServiceError("a result that contradicts itself")
        return [r["validation_error"] for r in results]


@dataclass(frozen=True)
class Parser:
    """A parsing service: upload (known content isn't sent again), a job that is asked for until it ends, the archive, and removal of what was stored."""

    base_url: str
    api_key: str = ""
    headers: dict = field(default_factory=dict)
    poll_s: float = 15.0
    limit_s: float = 30 * 60.0

    def parse(self, name: str, content: bytes) -> bytes:
        http = Http(self.base_url, _bearer(self.api_key) | self.headers)
        stored: list[str] = []
        try:
            job = self._name(http.json("POST", "/v1/parse/jobs", {"files": [{"source": {"type": "file_id", "file_id": self._upload(http, name, content, stored)}}], "tier": "standard", "ocr_mode": "auto", "output_formats": ["zip"]}), "job_id")
            made = self._wait(http, job)
            try:
                result = made["files"][0]["output_files"]["zip"]["file_id"]
            except (KeyError, IndexError, TypeError):
                raise ServiceError("a job without an archive") from None
            if not isinstance(result, str) or not result:
                raise ServiceError("a job without an archive")
            stored.append(result)
            archive = http.call("GET", f"/v1/files/{quote(result)}/content")
            if not is_zipfile(io.BytesIO(archive)):
                raise ServiceError("the result is no ZIP archive")
            return archive
        finally:
            for file_id in stored:
                try:
                    http.call("DELETE", f"/v1/files/{quote(file_id)}", ok=(200, 202, 204))
                except ServiceError:
                    pass  # the result counts, not what the service keeps

    @staticmethod
    def _name(got: dict, key: str) -> str:
        if not isinstance(got.get(key), str) or not got[key]:
            raise ServiceError(f"an answer without {key}")
        return got[key]

    def _upload(self, http: Http, name: str, content: bytes, stored: list[str]) -> str:
        digest = hashlib.sha256(content).hexdigest()
        begun = http.json("POST", "/v1/uploads", {"filename": name, "bytes": len(content), "mime_type": "application/pdf", "purpose": "parse", "sha256sum": digest})
        upload, file = self._name(begun, "id"), begun.get("file")
        known = begun.get("status") == "completed" and isinstance(file, dict)
        if not known:
            http.call("PUT", f"/v1/uploads/{quote(upload)}/content", content, content_type="application/octet-stream")
            file = http.json("POST", f"/v1/uploads/{quote(upload)}/complete", {"sha256sum": digest}).get("file")
        file_id = self._name(file if isinstance(file, dict) else {}, "id")
        if not known:
            stored.append(file_id)
        return file_id

    def _wait(self, http: Http, job: str) -> dict:
        until = time.monotonic() + self.limit_s
        while time.monotonic() < until:
            got = http.json("GET", f"/v1/parse/jobs/{quote(job)}")
            if got.get("status") in ("completed", "partial"):
                return got
            if got.get("status") not in ("queued", "running"):
                raise ServiceError(f"the job ended as {got.get('status')}")
            time.sleep(self.poll_s)
        raise ServiceError("the job took too long")

    def health(self) -> str:
        """The service's version; an error if it isn't ready."""
        got = Http(self.base_url, _bearer(self.api_key), 10.0).json("GET", "/v1/health", ok=(200,))
        if got.get("status") != "ok" or not isinstance(got.get("version"), str) or not re.fullmatch(r"\d+(?:\.\d+)+(?:[-+][\w.-]+)?", got["version"]):
            raise ServiceError("the service isn't ready")
        return got["version"]


def parse_files(files: DataFrame, parser: Parser) -> DataFrame:
    """doc_id, content (an archive) and error for each of files(doc_id, filename, content): one request a row, in the task that holds it. A failure is the row's error. Write the result before using it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for name, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    out.append(parser.parse(name or "", content or b""))
                    errors.append(None)
                except ServiceError as e:
                    out.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(errors, pa.string())], ["doc_id", "content", "error"])

    return files.selectExpr("cast(doc_id as string)", "filename", "content").mapInArrow(run, "doc_id string, content binary, error string")


def listed(spark: SparkSession, http: Http, path: str, schema: str, **asked: str) -> DataFrame:
    """The items of a paged listing, 100 a page and 1,000 pages at most, as a table of the given columns, as settings.choose_endpoint takes them."""
    items: list[dict] = []
    for page in range(1, 1001):
        got = http.json("GET", f"{path}?{urlencode({**asked, 'page': page, 'perPage': 100})}", ok=(200,))
        if not isinstance(got.get("items"), list):
            raise ServiceError("a page without items")
        items += [x for x in got["items"] if isinstance(x, dict)]
        pages = got["pagination"].get("totalPage", 1) if isinstance(got.get("pagination"), dict) else 1
        if type(pages) is not int or not 0 <= pages <= 1000:
            raise ServiceError("a listing of an odd number of pages")
        if page >= pages:
            break
    return spark.createDataFrame([(json.dumps(x),) for x in items], "value string").select(F.from_json("value", schema).alias("x")).select("x.*")


def read_store(spark: SparkSession, url: str, table: str, parts: int = 1, key: str | None = None, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """A table of a store over JDBC; with an integer key and its bounds, in parts that are read at the same time."""
    if key is None:
        return spark.read.jdbc(url, table, properties=options)
    low, high = bounds or (0, 1 << 31)
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def write_store(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Appends rows to a table of a store over JDBC."""
    df.write.jdbc(url, table, mode="append", properties=options)
