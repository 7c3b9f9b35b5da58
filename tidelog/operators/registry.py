"""Schema registry: a small table of schemas by content, and which topics use them. A registry holds one row per distinct schema."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tidelog.sources import avro
from tidelog.sources.seglog import ObjectStore

#: Ids below it are the system's.
FIRST_ID = 100


class RegistryError(ValueError):
    """A registration that is refused."""


class Registry:
    """Kept in one document of an object store, written whole and anew with each registration, so a refused one leaves no trace."""

    def __init__(self, path: str):
        self.store = ObjectStore(path)
        self.doc = json.loads(self.store.get("registry.json")) if "registry.json" in self.store.list() else {"topics": {}, "schemas": {}, "uses": []}

    def _save(self, doc: dict) -> None:
        self.store.put("registry.json", json.dumps(doc).encode())
        self.doc = doc

    def create_topic(self, name: str, retention_hours: int = 168, now_us: int = 0) -> int:
        """The new topic's id; a name that is taken is an error."""
        if any(t["name"] == name for t in self.doc["topics"].values()):
            raise RegistryError(f"topic {name} exists")
        doc = json.loads(json.dumps(self.doc))
        number = doc["last_topic"] = doc.get("last_topic", 0) + 1
        doc["topics"][str(number)] = {"name": name, "retention_hours": retention_hours, "created_us": now_us}
        self._save(doc)
        return number

    def delete_topic(self, topic: int) -> bool:
        """Deletes the topic and what refers to it (uses of schemas); the schemas themselves and the log's index stay."""
        doc = json.loads(json.dumps(self.doc))
        gone = doc["topics"].pop(str(topic), None)
        doc["uses"] = [u for u in doc["uses"] if u[0] != topic]
        self._save(doc)
        return gone is not None

    def register(self, topic: int, schema, now_us: int = 0) -> int:
        """The schema's id for the topic. Equal content has one id; the same registration again changes nothing; a schema that can't read
        the topic's newest is refused, as is any with a wide union, the first one included."""
        if str(topic) not in self.doc["topics"]:
            raise RegistryError(f"no topic {topic}")
        value = json.loads(schema) if isinstance(schema, str) else schema
        avro.checked(value)
        avro.parse(value)
        digest, latest = avro.schema_hash(value), self.latest(topic)
        known = next((int(i) for i, s in self.doc["schemas"].items() if s["hash"] == digest), None)
        if known is not None and any(u[:2] == [topic, known] for u in self.doc["uses"]):
            return known
        if latest is not None and not avro.compatible(value, self.get(latest)):
            raise RegistryError(f"the schema can't read the topic's newest, {latest}")
        doc = json.loads(json.dumps(self.doc))
        number = known if known is not None else max([FIRST_ID - 1, *map(int, doc["schemas"])]) + 1
        doc["schemas"][str(number)] = {"hash": digest, "schema": value, "created_us": now_us} if known is None else doc["schemas"][str(known)]
        doc["uses"].append([topic, number, now_us])
        self._save(doc)
        return number

    def get(self, schema_id: int) -> dict | None:
        found = self.doc["schemas"].get(str(schema_id))
        return found["schema"] if found else None

    def by_hash(self, digest: str) -> int | None:
        return next((int(i) for i, s in self.doc["schemas"].items() if s["hash"] == digest), None)

    def of_topic(self, topic: int) -> list[int]:
        """Schema ids of the topic, newest first."""
        return [u[1] for u in sorted((u for u in self.doc["uses"] if u[0] == topic), key=lambda u: (-u[2], -u[1]))]

    def latest(self, topic: int) -> int | None:
        return next(iter(self.of_topic(topic)), None)

    def check(self, topic: int, schema) -> bool:
        """Whether the schema could be registered; any could where there is none yet."""
        latest = self.latest(topic)
        return latest is None or avro.compatible(schema, self.get(latest))

    def table(self, spark: SparkSession) -> DataFrame:
        """topic_id, schema_id, created_us, hash, schema_json: every use of a schema."""
        rows = [(t, i, at, self.doc["schemas"][str(i)]["hash"], avro.canonical(self.get(i))) for t, i, at in self.doc["uses"]]
        return spark.createDataFrame(rows, "topic_id long, schema_id long, created_us long, hash string, schema_json string")
