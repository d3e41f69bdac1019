"""Archives that another writer made, and URLs with line ends in them."""

import gzip
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import warc


def member(headers, block, length=None):
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block) if length is None else length}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


HTTP = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nhello"
INFO = member({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:uuid:6a9f>", "Content-Type": "application/warc-fields"}, b"software: other\r\n")
RESPONSE = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:7b>", "WARC-Target-URI": "http://a/%20b", "Content-Type": "application/http;\r\n msgtype=response"}


def read(spark, *members, **how):
    return warc.read_warc(spark.createDataFrame([("a", b"".join(members))], warc.ARCHIVES), payload=True, **how)


def test_records_of_every_type(spark):
    hexed = member(RESPONSE | {"WARC-Payload-Digest": "sha1:" + hashlib.sha1(b"hello").hexdigest()}, HTTP)
    other = member(RESPONSE | {"WARC-Payload-Digest": "md5:00"}, HTTP)
    revisit = member({"WARC-Type": "revisit", "WARC-Record-ID": "<urn:uuid:8c>", "WARC-Refers-To": "<urn:uuid:7b>", "WARC-Payload-Digest": "sha1:" + warc.sha1_base32(b"hello"), "Content-Type": "application/http"}, b"HTTP/1.1 304 X\r\n\r\n")
    rows = read(spark, INFO, member(RESPONSE, HTTP), hexed, other, revisit, member({"WARC-Type": "metadata"}, b"")).collect()
    own = [(r.record_type, r.record_id, r.page_id, r.target_uri, r.payload_bytes, r.payload_digest, r.refers_to, r.digest_ok, r.payload and bytes(r.payload)) for r in rows]
    sha = warc.sha1_base32(b"hello")
    assert own == [
        ("warcinfo", "<urn:uuid:6a9f>", None, None, 17, None, None, True, b"software: other\r\n"),
        ("response", "<urn:uuid:7b>", None, "http://a/%20b", 5, sha, None, True, b"hello"),
        ("response", "<urn:uuid:7b>", None, "http://a/%20b", 5, hashlib.sha1(b"hello").hexdigest(), None, True, b"hello"),
        ("response", "<urn:uuid:7b>", None, "http://a/%20b", 5, "md5:00", None, True, b"hello"),
        ("revisit", "<urn:uuid:8c>", None, None, None, sha, None, True, None),
        ("metadata", None, None, None, 0, None, None, True, b""),
    ]


def test_wrong_digests_and_framing_of_others(spark):
    wrong = member(RESPONSE | {"WARC-Payload-Digest": "sha1:" + warc.sha1_base32(b"other")}, HTTP)
    assert [r.digest_ok for r in read(spark, INFO, wrong, strict=False).collect()] == [True, False]
    for bad in (wrong, member(RESPONSE, HTTP, length=999)):
        with pytest.raises(Exception):
            read(spark, bad).collect()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("%250DA\r\nx"), max_size=14))
def test_urls_come_back(url):
    assert warc.header_url(warc.header_value(url)) == url and not set("\r\n") & set(warc.header_value(url))
