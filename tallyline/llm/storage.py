"""The package's tables in the shared folder."""

from ..storage import released, shared_folder, shuffles_dropped, written

__all__ = ["released", "shared_folder", "shuffles_dropped", "written"]
