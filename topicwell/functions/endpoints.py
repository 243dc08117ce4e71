"""Endpoint addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: optional scheme, host name or bracketed IPv6 address, and a port of 1 to 5 digits.
# ``(?d)`` lets ``$`` accept a single trailing line feed, but not a carriage return.
ENDPOINT = r"(?d)^(?:grpcs?://)?(?:[a-zA-Z0-9.\-]+|\[[0-9a-fA-F:]+\]):([0-9]{1,5})$"


def valid_endpoint(address: Column) -> Column:
    """True if ``address`` is well formed and its port lies in 1..65535; never null."""
    port = F.regexp_extract(address, ENDPOINT, 1).try_cast("int")
    return F.coalesce(port.between(1, 65535), F.lit(False))
