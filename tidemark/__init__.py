"""tidemark: point-in-time panel analytics as Spark DataFrame transformations."""

from tidemark.profile import CORRECTED, FROZEN, Profile

__all__ = ["CORRECTED", "FROZEN", "Profile"]
