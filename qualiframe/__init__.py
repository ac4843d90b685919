"""qualiframe: data-quality profiling, issue detection, scoring and cleaning as Spark plans."""
