from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobtide.functions import ids, rendering, status, text, times, urls
from jobtide.functions.json import is_whole, parse_document


def value(spark, value, expression):
    """One text value through a column function."""
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw, clean", [
    ("My genome #1 (v2).fa", "My_genome_1_v2_.fa"),
    ("Ünï cöde", "_n_c_de"),
    ("!!!", ""),
    ("a" * 62 + " b c", "a" * 62),
    ("a" * 70, "a" * 63),
    ("ab__..", "ab"),
    ("", ""),
])
def test_clean_name(spark, raw, clean):
    assert value(spark, raw, text.clean_name) == clean


@pytest.mark.parametrize("raw, clean", [
    ("https://a.b/c d", "a.b_c_d"),
    ("https://https://a", "https_a"),
    ("http://a.b", "http_a.b"),
    ("tab\there", "tab_here"),
    ("a.b.", "a.b."),
    ("", ""),
    ("https://é.org", "Unknown"),
    ("a\nb", "Unknown"),
    (None, "Unknown"),
])
def test_clean_origin(spark, raw, clean):
    assert value(spark, raw, text.clean_origin) == clean


def test_quote(spark):
    assert value(spark, "Ba'c", text.quote) == "'Bac'"
    assert value(spark, "'", text.quote) == "''"


@pytest.mark.parametrize("line, seen", [
    ("", False), ("  \t", False), ("\u00a0", False), ("\u2003\u3000", False),
    ("x", True), ("  .", True),
])
def test_has_text(spark, line, seen):
    assert value(spark, line, text.has_text) is seen


CANONICAL = "6f1c0b2a-1111-4abc-9def-0123456789ab"


@pytest.mark.parametrize("raw, canonical", [
    (CANONICAL, CANONICAL),
    (CANONICAL.upper(), CANONICAL),
    (CANONICAL.replace("-", "").upper(), CANONICAL),
    ("{" + CANONICAL + "}", CANONICAL),
    ("urn:uuid:" + CANONICAL, CANONICAL),
    ("URN:UUID:" + CANONICAL, None),
    ("urn:uuid:" + CANONICAL.replace("-", ""), None),
    ("{" + CANONICAL, None),
    (CANONICAL + "\n", None),
    ("6f1c0b2a1-111-4abc-9def-0123456789ab", None),
    ("nope", None),
    ("", None),
    (None, None),
])
def test_canonical_uuid(spark, raw, canonical):
    assert value(spark, raw, ids.canonical_uuid) == canonical


@pytest.mark.parametrize("phase, public, terminal, loose, strict", [
    ("Init", "INIT", False, False, False),
    ("Pending", "INIT", False, False, False),
    ("Running", "RUNNING", False, False, False),
    ("Succeeded", "SUCCESSFUL", True, True, True),
    ("Failed", "ERROR", True, False, False),
    ("Error", "ERROR", True, False, False),
    (None, None, False, True, False),
])
def test_status(spark, phase, public, terminal, loose, strict):
    assert value(spark, phase, status.known_phase) == phase
    assert value(spark, phase, status.public_status) == public
    assert value(spark, phase, status.is_terminal) is terminal
    assert value(spark, phase, status.results_ready) is loose
    assert value(spark, phase, lambda c: status.results_ready(c, strict=True)) is strict


@pytest.mark.parametrize("phase", ["running", "Omitted", ""])
def test_unknown_phase(spark, phase):
    assert value(spark, phase, status.known_phase) is None


@pytest.mark.parametrize("raw, instant", [
    ("2024-04-01T08:00:00Z", datetime(2024, 4, 1, 8)),
    ("2024-04-01t08:00:00z", datetime(2024, 4, 1, 8)),
    ("2024-04-01 08:00:00+02:00", datetime(2024, 4, 1, 6)),
    ("2024-04-01T08:00:00-0530", datetime(2024, 4, 1, 13, 30)),
    ("2024-04-01T08:00:00.123456789Z", datetime(2024, 4, 1, 8, 0, 0, 123456)),
    ("2024-04-01T08:00:00", None),
    ("2024-04-01", None),
    ("2024-13-01T08:00:00Z", None),
    (None, None),
])
def test_parse_rfc3339(spark, raw, instant):
    assert value(spark, raw, times.parse_rfc3339) == instant


def test_or_epoch(spark):
    assert value(spark, None, lambda c: times.or_epoch(c.cast("timestamp"))) == datetime(1970, 1, 1)


def test_pairs_are_sorted(spark):
    row = spark.range(1).select(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")).alias("m"))
    assert row.select(rendering.pair_string(F.col("m"))).first()[0] == "a=1,b=2"
    assert row.select(rendering.pairs(F.col("m"))).first()[0] == ["a=1", "b=2"]


CONFIG = ("prodigal_training_file string, has_replicons boolean, translation_table smallint, "
          "complete_genome boolean, keep_contig_headers boolean, min_contig_length decimal(20,0), "
          "derm_type string, genus string, species string, strain string, plasmid string, "
          "locus string, locus_tag string, compliant boolean")
EMPTY = dict(
    prodigal_training_file=None, has_replicons=False, translation_table=0, complete_genome=False,
    keep_contig_headers=False, min_contig_length=0, derm_type=None, genus=None, species=None,
    strain=None, plasmid=None, locus=None, locus_tag=None, compliant=False)


def parameters(spark, **changed):
    from decimal import Decimal

    row = EMPTY | changed
    row["min_contig_length"] = Decimal(row["min_contig_length"])
    return spark.createDataFrame([tuple(row.values())], CONFIG).select(
        rendering.parameter_string()).first()[0]


def test_parameters_of_full_config(spark):
    assert parameters(
        spark, prodigal_training_file="train.bin", has_replicons=True, translation_table=4,
        complete_genome=True, keep_contig_headers=True, min_contig_length=250,
        derm_type="MONODERM", genus="Vibrio", species="natriegens", strain="Vn 9",
        plasmid="pX1", locus="VN_7", locus_tag="VNT7", compliant=True,
    ) == (
        "--min-contig-length 250 --prodigal /data/prodigal.tf --replicons /data/replicons.tsv "
        "--complete --locus 'VN_7' --locus-tag 'VNT7' --keep-contig-headers --genus 'Vibrio' "
        "--species 'natriegens' --strain 'Vn 9' --plasmid 'pX1' --compliant "
        "--translation-table 4 --gram +")


@pytest.mark.parametrize("changed, rendered", [
    ({}, "--gram ?"),
    ({"min_contig_length": 1}, "--gram ?"),
    ({"min_contig_length": 2}, "--min-contig-length 2 --gram ?"),
    ({"min_contig_length": 2**64 - 1}, "--min-contig-length 18446744073709551615 --gram ?"),
    ({"prodigal_training_file": ""}, "--prodigal /data/prodigal.tf --gram ?"),
    ({"genus": ""}, "--gram ?"),
    ({"genus": "'"}, "--genus '' --gram ?"),
    ({"species": "a'b c"}, "--species 'ab c' --gram ?"),
    ({"translation_table": 11}, "--gram ?"),
    ({"derm_type": "DIDERM"}, "--gram -"),
    ({"derm_type": "UNKNOWN"}, "--gram ?"),
])
def test_parameters(spark, changed, rendered):
    assert parameters(spark, **changed) == rendered


def test_disposition(spark):
    assert value(spark, "a b*-_.~é.gff3", urls.encoded_disposition) == (
        "attachment%3B+filename%3D%22a+b*-_.%7E%C3%A9.gff3%22")


@pytest.mark.parametrize("endpoint, url", [
    ("https://s3.org", "https://b.s3.org/k"),
    ("http://s3.org", "http://b.s3.org/k"),
    ("s3.org", "http://b.s3.org/k"),
])
def test_object_url(spark, endpoint, url):
    assert value(spark, endpoint, lambda c: urls.object_url(c, F.lit("b"), F.lit("k"))) == url


def test_object_url_with_download_name(spark):
    url = value(spark, "https://s3.org", lambda c: urls.object_url(
        c, F.lit("b"), F.lit("k"), F.lit("x.tsv")))
    assert url == ("https://b.s3.org/k?response-content-disposition="
                   "attachment%3B+filename%3D%22x.tsv%22")


def test_template_names(spark):
    assert rendering.template_name("annotate", "1.0") == "annotate-1.0"
    assert value(spark, "id", lambda c: rendering.generate_name("annotate", c)) == "annotate-id-"


@pytest.mark.parametrize("raw, whole", [
    ('{"a":1}', True), ('{"a":1} ', True), ('{"a":1} x', None), ('{"a":1},{"a":2}', False),
    ("", False), ('{"a":1', None), ('{"a":1,"a":2}', None),
])
def test_is_whole(spark, raw, whole):
    seen = value(spark, raw, lambda c: is_whole(parse_document(c)))
    assert bool(seen) is bool(whole)
