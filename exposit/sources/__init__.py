from exposit.sources.tables import load, shared_dir, scratch

__all__ = ["load", "shared_dir", "scratch"]
