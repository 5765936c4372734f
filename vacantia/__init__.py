"""A Spark-first engine for job-posting data: parse, classify, link, merge, search and feed."""
