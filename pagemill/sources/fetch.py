"""Fetching documents over HTTP as an operator on a table of URLs.

Each host is one task's, so that the gap between its requests holds without any lock. Server errors and failed connections
are tried again after growing pauses; other answers count at once. Nothing is fetched before an action runs, and a lost
task fetches its hosts again.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.sources.pages import is_challenge

FETCHED = "site string, url string, status int, content_type string, body string, attempts int, fetched_at timestamp"
FETCHED_BYTES = FETCHED.replace("body string", "content binary")
#: Images of fewer bytes are dots and counters.
LEAST_BYTES = 1_024
USER_AGENT = "Mozilla/5.0 (compatible; pagemill/0.1)"
#: First pause before another attempt, its growth and its limit, in seconds.
PAUSE, GROWTH, LIMIT = 0.2, 3.0, 10.0


def fetch_one(url: str, timeout: float = 30.0, retries: int = 3, headers: dict[str, str] | None = None, sleep: Callable[[float], None] = time.sleep, binary: bool = False) -> tuple[int | None, str | None, str | bytes | None, int]:
    """Status, content type, body (its bytes if ``binary``) and number of attempts; the status is null if no attempt got an answer."""
    request_headers = {"User-Agent": USER_AGENT, "Accept-Language": "en-US"} | (headers or {})
    pause, status = PAUSE, None
    for attempt in range(1, retries + 2):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=request_headers), timeout=timeout) as answer:
                charset = answer.headers.get_content_charset() or "utf-8"
                raw = answer.read()
                if binary:
                    return answer.status, answer.headers.get_content_type(), raw, attempt
                try:
                    text = raw.decode(charset, "replace")
                except LookupError:
                    text = raw.decode("utf-8", "replace")
                return answer.status, answer.headers.get_content_type(), text, attempt
        except urllib.error.HTTPError as e:
            status = e.code
            if status < 500:
                return status, e.headers.get_content_type() if e.headers else None, None, attempt
        except (OSError, ValueError) as e:  # ValueError: not a URL that can be opened
            if isinstance(e, ValueError):
                return None, None, None, attempt
        if attempt <= retries:
            sleep(pause)
            pause = min(pause * GROWTH, LIMIT)
    return status, None, None, retries + 1


def fetch(url_list: DataFrame, delay_ms: int = 0, timeout: float = 30.0, retries: int = 3, headers: dict[str, str] | None = None, binary: bool = False) -> DataFrame:
    """Answers for distinct URLs (columns site and url); ``delay_ms`` is the least gap between requests to a host.

    With ``binary`` the column ``content`` holds bytes in place of the text ``body``.
    """
    schema = FETCHED_BYTES if binary else FETCHED
    names = [c.split()[0] for c in schema.split(", ")]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for frame in frames:
            rows = []
            for site, url, host in frame[["site", "url", "host"]].itertuples(index=False):
                wait = last.get(host, float("-inf")) + delay_ms / 1000 - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                last[host] = time.monotonic()
                rows.append((site, url, *fetch_one(url, timeout, retries, headers, binary=binary), pd.Timestamp.now(tz="UTC")))
            yield pd.DataFrame(rows, columns=names).astype({"status": "Int32"})

    wanted = url_list.where("url IS NOT NULL").select("site", "url", urls.host(F.col("url")).alias("host")).distinct()
    return wanted.repartition("host").mapInPandas(work, schema)


def origin(url):
    """Scheme and host of a URL."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def robots_urls(url_list: DataFrame) -> DataFrame:
    """The robots file of each site: site, url (that of the smallest URL's scheme and host)."""
    return url_list.where(origin("url") != "").groupBy("site").agg(F.min("url").alias("url")).select("site", F.concat(origin("url"), F.lit("/robots.txt")).alias("url"))


def robots_files(fetched: DataFrame) -> DataFrame:
    """Answers for robots files as input of ``discover.robots_rules``: site, body; whatever failed has no rules."""
    return fetched.select("site", F.when(F.col("status").between(200, 299), F.col("body")).otherwise("").alias("body"))


def probe_urls(url_list: DataFrame, token: str) -> DataFrame:
    """An address of each site that cannot exist, to see how it says so: site, url. ``token`` keeps runs apart."""
    return url_list.where(origin("url") != "").groupBy("site").agg(F.min("url").alias("url")).select("site", F.concat(origin("url"), F.lit("/pagemill-probe-"), F.left(F.sha2(F.concat_ws("/", F.lit(token), "site"), 256), F.lit(12))).alias("url"))


def images(fetched_bytes: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Images among the answers of a binary fetch: site, url, path, content; no trackers, and none of fewer than ``least`` bytes."""
    path = urls.asset_path(F.col("url"))
    return fetched_bytes.where(F.col("status").between(200, 299) & (F.octet_length("content") >= least) & path.isNotNull()).select("site", "url", path.alias("path"), "content")


def named_assets(fetched_bytes: DataFrame, name: str) -> DataFrame:
    """Icons or logos among the answers: site, url, path, content; the extension is that of the content type, else of the URL."""
    extension = F.coalesce(urls.content_type_extension(F.col("content_type")), urls.image_extension(F.col("url")))
    return fetched_bytes.where(F.col("status").between(200, 299) & (F.octet_length("content") > 0)).select("site", "url", F.concat(F.lit(f"images/{name}."), extension).alias("path"), "content")


def write_assets(assets: DataFrame, root: str) -> DataFrame:
    """Writes each asset (site, path, content) to its path below its site's folder of ``root``, a folder that all executors share; returns site, path, size_bytes.

    Every task writes through the session's file system; a task that runs again writes the same files.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for frame in frames:
            for site, path, content in frame[["site", "path", "content"]].itertuples(index=False):
                target = f"{base.rstrip('/')}/{site}/{path}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(content)
            yield pd.DataFrame({"site": frame["site"], "path": frame["path"], "size_bytes": frame["content"].map(len)})

    return assets.select("site", "path", "content").mapInPandas(work, "site string, path string, size_bytes bigint")


def raw_pages(fetched: DataFrame) -> DataFrame:
    """Pages among the answers, as input of ``capture``: page_id (from the URL), url, html."""
    good = fetched.where(F.col("status").between(200, 299) & ~is_challenge(F.col("body")))
    return good.select(F.xxhash64("url").alias("page_id"), "url", F.col("body").alias("html"))


def skipped_pages(fetched: DataFrame) -> DataFrame:
    """The other answers with the reason: bot_protected, http_error or render_failed."""
    reason = F.when(F.col("status").isNull(), "render_failed").when(~F.col("status").between(200, 299), "http_error").when(is_challenge(F.col("body")), "bot_protected")
    return fetched.select("site", "url", reason.alias("reason"), F.col("fetched_at").alias("attempted_at")).where("reason IS NOT NULL")
