"""civitally: public-works spending triage expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
