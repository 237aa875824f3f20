"""Sentence-piece ids of whole texts, and texts of ids, by the prefix table of `piece_model`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefrank.llm.piece_model import PieceModel
from prefrank.llm.scratch import tidy

_models: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    """The model of a file, loaded once in a worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_pieces(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", end_id: bool = True,
                  decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` in an array column ``ids``, and the text of these ids in ``decoded`` if it is named.

    The ids are those of the model's own merging without sampling, then its end id (with
    ``end_id``). Null and empty texts give the end id alone. Texts of any length are encoded
    whole, in time proportional to their length; a worker holds one batch and bounded tables and caches (four bytes for
    each character of a longer fragment). Rows are independent: repeated rows and ties give repeated results, an
    empty table an empty one. Other columns pass through; one named like an added one is replaced. ``model`` is a path
    that every executor can open; a model that normalises texts, or is not of the merging type, is a ValueError.
    """
    PieceModel(model)
    whole = decoded is not None

    @F.arrow_udf("struct<ids:array<int>,decoded:string>" if whole else "struct<ids:array<int>>")
    def encode(texts: pa.Array) -> pa.Array:
        coder = model_of(model)
        tail = np.int32(coder.end_id).tobytes() if end_id else b""
        coded = [ids + tail for ids in coder.encode_all(value.as_py() or "" for value in texts)]
        bounds = np.r_[0, np.cumsum([len(c) // 4 for c in coded])].astype(np.int32)
        columns = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(coded), np.int32)))]
        if whole:
            columns.append(pa.array([coder.decode(memoryview(c).cast("i").tolist()) for c in coded], pa.string()))
        return pa.StructArray.from_arrays(columns, names=["ids", "decoded"][:1 + whole])

    # Otherwise the optimizer may copy the encoding into every expression that uses the ids.
    once = encode.asNondeterministic()
    names = {ids: "ids"} | ({decoded: "decoded"} if whole else {})
    return docs.select("*", once(F.col(text)).alias("_coded")).select(
        *tidy(docs, *names).columns, *[F.col(f"_coded.{part}").alias(name) for name, part in names.items()])


def decode_pieces(coded: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``coded`` with the text of an array of ids.

    Null and empty arrays give an empty text, control ids nothing, the unknown id its mark;
    bytes that are no UTF-8 become U+FFFD one by one. An id outside the model, or a null one, is an error.
    Other columns pass through; one named like ``text`` is replaced.
    """
    PieceModel(model)

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        coder = model_of(model)
        flat = rows.flatten()
        if flat.null_count or len(flat) and flat.to_numpy().min() < 0:
            raise ValueError("ids are numbers from 0")
        values = flat.to_numpy()
        ends = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy())
        return pa.array([coder.decode(values[a:b].tolist()) for a, b in zip(np.r_[0, ends[:-1]], ends)], pa.string())

    return tidy(coded, text).select("*", decode(coded[ids]).alias(text))
