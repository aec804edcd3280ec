"""Image names, hosts and service addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from muster import fixed_values as fv
from muster.functions.common import ColumnOrName, as_col, set_or_null

# scheme://[user@]host[:port]
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def normalise_image(image: ColumnOrName, user: ColumnOrName) -> Column:
    """Absolute paths and ``docker://`` stay; tagged names get the scheme; the rest is the user's file."""
    image, user = set_or_null(image), as_col(user)
    home = F.concat(F.lit("/scratch/"), user, F.lit("/"))
    return (
        F.when(image.isNull(), F.concat(home, F.lit(fv.DEFAULT_IMAGE_FILE)))
        .when(image.startswith("/") | image.startswith(fv.IMAGE_SCHEME), image)
        .when(image.contains(":"), F.concat(F.lit(fv.IMAGE_SCHEME), image))
        .otherwise(F.concat(home, image))
    )


def rewrite_host(url: ColumnOrName, host: str = fv.CONTAINER_HOST) -> Column:
    """Local addresses become the name that reaches the machine from a container."""
    out = as_col(url)
    for local in fv.LOCAL_HOSTS:
        out = F.replace(out, F.lit(local), F.lit(host))
    return out


def strip_api_suffix(url: ColumnOrName) -> Column:
    """Drop closing slashes and one closing ``/v1``."""
    return F.regexp_replace(F.regexp_replace(as_col(url), r"/+$", ""), r"/v1$", "")


def url_host(url: ColumnOrName) -> Column:
    authority = F.regexp_extract(as_col(url), _AUTHORITY, 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""), F.lit(""))


def url_port(url: ColumnOrName, default: int | Column = fv.DEFAULT_PORT) -> Column:
    """Port written in the address; none, zero or out of range gives the default."""
    default = default if isinstance(default, Column) else F.lit(default)
    authority = F.regexp_extract(as_col(url), _AUTHORITY, 1)
    port = F.regexp_extract(authority, r":(\d{1,9})$", 1).try_cast("int")
    return F.when(port.between(1, fv.PORT_MAX), port).otherwise(default)


def api_base(host: ColumnOrName, port: ColumnOrName) -> Column:
    return F.concat(F.lit("http://"), as_col(host), F.lit(":"), as_col(port).cast("string"), F.lit("/v1"))


def health_url(host: ColumnOrName, port: ColumnOrName) -> Column:
    return F.concat(F.lit("http://"), as_col(host), F.lit(":"), as_col(port).cast("string"), F.lit("/health"))


def models_url(host: ColumnOrName, port: ColumnOrName) -> Column:
    return F.concat(api_base(host, port), F.lit("/models"))
