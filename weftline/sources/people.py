"""People as JSON, the way a serving layer lists them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PERSON = "person_id bigint, full_name string, primary_email string, primary_phone string, city string, skills string, skill_category string"


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """(person_id, full_name, ..., skill_category) from JSON files under path, each an
    array of objects or one object. Fields that an object lacks are null, others
    are left out; what is no JSON is left out too, as are objects without a person_id.
    A path without files raises."""
    return spark.read.schema(PERSON).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path).where("person_id is not null")


def read_people_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from one object a line, which large files can be split at."""
    return spark.read.schema(PERSON).option("mode", "DROPMALFORMED").json(path).where("person_id is not null")
