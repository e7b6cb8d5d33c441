"""Session helpers of the core, under the names this package uses."""

from lakewright.session import checkpoint_dir, cut, join_counted, partitions, release  # noqa: F401
