"""Albums out of time- and place-stamped items, as Spark jobs."""

from geoalbums.config import AlbumConfig
from geoalbums.plans.grouping import AlbumRun, build_albums

__all__ = ["AlbumConfig", "AlbumRun", "build_albums"]
