"""Optional descriptions of persons (UDF8, UDF9): any function from thumbnail bytes to text, off by default."""

from __future__ import annotations

import base64
import json
import logging
from collections.abc import Callable
from dataclasses import dataclass
from urllib import request

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class ChatEndpoint:
    """A chat service that takes an image as a data address. Calling it is the user's choice."""

    endpoint: str
    model: str
    prompt: str
    max_tokens: int = 200
    timeout: float = 120.0

    def __call__(self, image: bytes) -> str:
        url = "data:image/jpeg;base64," + base64.b64encode(image).decode()
        content = [{"type": "text", "text": self.prompt}, {"type": "image_url", "image_url": {"url": url}}]
        body = {"model": self.model, "temperature": 0.1, "max_tokens": self.max_tokens or 200, "messages": [{"role": "user", "content": content}]}
        call = request.Request(self.endpoint.rstrip("/") + "/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with request.urlopen(call, timeout=self.timeout) as r:
            answer = json.load(r)
        if answer.get("error"):
            raise RuntimeError(str(answer["error"]))
        if not answer.get("choices"):
            raise RuntimeError("no choices in the answer")
        return answer["choices"][0]["message"]["content"].strip()


def describe(persons: DataFrame, describer: Callable[[bytes], str], thumbnails: DataFrame) -> DataFrame:
    """``persons`` with ``description``; ``thumbnails(thumbnail, content)``.

    Persons without a thumbnail are skipped; a failure is logged and leaves the description empty.
    """
    small = persons.where("thumbnail <> ''").select("id", "thumbnail").join(thumbnails, "thumbnail").select("id", "content")

    def run(batches):
        for pdf in batches:
            texts = []
            for pid, content in zip(pdf.id, pdf.content):
                try:
                    texts.append(describer(bytes(content)))
                except Exception as e:
                    log.warning("person %s: no description: %s", pid, e)
                    texts.append("")
            yield pd.DataFrame({"id": pdf.id, "description": texts})

    told = small.mapInPandas(run, T.StructType([T.StructField("id", T.LongType()), T.StructField("description", T.StringType())]))
    return persons.drop("description").join(told, "id", "left").withColumn("description", F.coalesce("description", F.lit("")))
