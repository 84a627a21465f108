"""Documents to chunks: with responses that are there already, or with a live backend as a fold over each document."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chunks as C

MODEL_VARIABLE = "QUIRE_VLM_MODEL"


def model_name(model: str | None = None) -> str:
    """The given model, else that of the environment; ValueError if there is none."""
    found = model or os.environ.get(MODEL_VARIABLE)
    if not found:
        raise ValueError(f"no model: pass one or set {MODEL_VARIABLE}")
    return found


class Backend(Protocol):
    """Answers a request; it must be picklable, as it runs on executors."""

    def __call__(self, model: str, content: list[dict], max_output_tokens: int, temperature: float) -> str: ...


def parse_env(lines) -> dict[str, str]:
    """The settings of ``NAME=value`` lines; comments, ``export`` and quotes are allowed."""
    found: dict[str, str] = {}
    for line in lines:
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        name, value = name.strip(), value.strip()
        if not equals or not name or name.startswith("#"):
            continue
        if value[:1] in ("'", '"') and value.find(value[0], 1) > 0:
            value = value[1 : value.find(value[0], 1)]
        else:
            value = value.partition(" #")[0].strip()
        found[name] = value
    return found


def load_env(path: str = ".env") -> dict[str, str]:
    """The settings of a file, if it is there, put into the environment where they are not set yet."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        found = parse_env(f)
    for name, value in found.items():
        os.environ.setdefault(name, value)
    return found


class Responses:
    """Any client library with ``responses.create``; ``make`` builds the client on the executor, once for a task."""

    def __init__(self, make: Callable[[], object]):
        self.make, self._client = make, None

    def __getstate__(self) -> dict:
        return {"make": self.make, "_client": None}

    def __call__(self, model: str, content: list[dict], max_output_tokens: int, temperature: float) -> str:
        if self._client is None:
            self._client = self.make()
        return self._client.responses.create(model=model, input=[{"role": "user", "content": content}], temperature=temperature, max_output_tokens=max_output_tokens).output_text


class RuleBased:
    """A local stand-in without network: each labelled page of the prompt becomes chunks, a paragraph each."""

    def __call__(self, model: str, content: list[dict], max_output_tokens: int, temperature: float) -> str:
        page, chunks = None, []
        for line in content[0]["text"].rsplit("Text of the pages:", 1)[-1].splitlines():
            if line.startswith("--- page ") and line.endswith(" ---"):
                page = int(line.split()[2])
            elif page and line.strip():
                chunks.append({"chunk_text": line.strip(), "page_start": page, "page_end": page, "content_type": "paragraph", "continuation_status": "new"})
        return json.dumps({"batch_summary": f"{len(chunks)} paragraphs", "chunks": chunks})


AT_ONCE = 256  # requests that a task holds with their answers
RESPONSE = "doc_id string, batch_no int, output_text string, error string"


def content_of(prompt: str, images) -> list[dict]:
    """The request's parts: the text, then the images."""
    return [{"type": "input_text", "text": prompt}, *({"type": "input_image", "image_url": u} for u in (images if images is not None else []))]


def filled(template: str, values: dict[str, object]) -> str:
    for k, v in values.items():
        template = template.replace("{{" + k + "}}", str(v))
    return template


def live_responses(batches: DataFrame, backend: Backend, model: str, max_output_tokens: int = 8000, temperature: float = 0.1, template: str = T.CHUNK_TEMPLATE) -> DataFrame:
    """RESPONSE rows. batches: doc_id, document_id, source, batch_no, page_start, page_end, page_text, known_outline, images.

    The fold carries a summary and the last chunk from batch to batch, so a document's batches are asked in order by one
    task, which goes through its documents one after the other; documents run side by side. Write the result before use:
    a repeated task asks again. An error ends its document only.
    """
    names = ["doc_id", "document_id", "source", "batch_no", "page_start", "page_end", "page_text", "known_outline", "images"]

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = summary = last = None
        failed = False
        for part in (p.slice(at, AT_ONCE) for p in parts for at in range(0, p.num_rows, AT_ONCE)):
            rows = []
            for r in part.to_pylist():
                if doc is None or r["doc_id"] != doc:
                    doc, summary, last, failed = r["doc_id"], "", "", False
                if failed:
                    continue
                values = {k: r[k] for k in ("document_id", "source", "page_start", "page_end")}
                values |= {"previous_batch_summary": summary, "previous_last_chunk": last, "extracted_page_text": r["page_text"] or T.NO_PAGE_TEXT, "known_outline": r["known_outline"] or T.NO_OUTLINE}
                text = error = None
                try:
                    text = backend(model, content_of(filled(template, values), r["images"]), max_output_tokens, temperature)
                    found = T.extract_json(text)
                    if not isinstance(found, dict):
                        raise ValueError("the response is no JSON object")
                    summary = found.get("batch_summary") or summary
                    if found.get("chunks"):
                        last = json.dumps(found["chunks"][-1], ensure_ascii=False)
                except Exception as e:  # noqa: BLE001  one document's failure leaves the others alone
                    text, error, failed = None, f"{type(e).__name__}: {e}", True
                rows.append((str(doc), r["batch_no"], text, error))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["doc_id", "batch_no", "output_text", "error"])

    return batches.select(*names).repartition("doc_id").sortWithinPartitions("doc_id", "batch_no").mapInArrow(fold, RESPONSE)


def live_outlines(documents: DataFrame, backend: Backend, model: str, max_output_tokens: int = 2000, temperature: float = 0.1, template: str = T.OUTLINE_TEMPLATE) -> DataFrame:
    """doc_id, outline (text of the known outline), error. documents: doc_id, document_id, source, text, images."""

    def ask(frames):
        for f in frames:
            rows = []
            for r in f.itertuples():
                prompt = filled(template, {"document_id": r.document_id, "source": r.source, "extracted_text": r.text or T.NO_DOCUMENT_TEXT})
                content = content_of(prompt, r.images)
                try:
                    rows.append((str(r.doc_id), json.dumps(T.extract_json(backend(model, content, max_output_tokens, temperature))), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((str(r.doc_id), None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "json", "error"])

    out = documents.mapInPandas(ask, "doc_id string, json string, error string")
    return out.select("doc_id", T.render_known_outline(F.from_json("json", T.OUTLINE_TYPE)).alias("outline"), "error")


def process(blocks: DataFrame, responses: DataFrame, documents: DataFrame, resolver: Callable[[Column, Column], Column] = T.id_resolver, batch_size: int = 2, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chunks in the chunk schema with doc_id, status of each document).

    blocks: doc_id, page_num, block_no, batch_no, text; responses: doc_id, batch_no, output_text; documents: doc_id,
    document_id, source, source_url, n_pages. A document with one bad response or chunk yields no chunks.
    """
    raw = C.ingest(responses, strict)
    status = C.document_status(raw, documents=documents)
    raw = C.only_sound(raw, status).where("error is null").drop("error").join(documents.select("doc_id", "n_pages"), "doc_id")
    start = F.col("batch_no") * batch_size + 1
    chunks = C.normalize(raw, start, F.least(start + batch_size - 1, F.col("n_pages"))).drop("n_pages")
    sound = C.only_sound(blocks, status)
    done = C.union_recovered(chunks, sound).join(documents.drop("n_pages"), "doc_id")
    return C.finish(done, F.col("document_id"), F.col("source"), F.col("source_url"), resolver, ("doc_id",)), status
