"""Object keys, download headers and unsigned object URLs."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def input_key(job_id: Column, file: Column) -> Column:
    return F.concat(F.lit("jobs/"), job_id, F.lit("/inputs/"), file)


def result_key(job_id: Column, extension: Column) -> Column:
    return F.concat(F.lit("jobs/"), job_id, F.lit("/results/result."), extension)


def download_name(name: Column, extension: Column) -> Column:
    return F.concat(name, F.lit("."), extension)


def encoded_disposition(filename: Column) -> Column:
    """Form-encoded attachment header for a download name."""
    return F.url_encode(F.concat(F.lit('attachment; filename="'), filename, F.lit('"')))


def object_url(endpoint: Column, bucket: Column, key: Column,
               filename: Column | None = None) -> Column:
    """Bucket-as-host URL; plain http unless the endpoint asks for https."""
    scheme = F.when(F.startswith(endpoint, F.lit("https://")), "https://").otherwise("http://")
    host = F.regexp_replace(endpoint, r"\Ahttps?://", "")
    url = F.concat(scheme, bucket, F.lit("."), host, F.lit("/"), key)
    if filename is None:
        return url
    return F.concat(url, F.lit("?response-content-disposition="), encoded_disposition(filename))
