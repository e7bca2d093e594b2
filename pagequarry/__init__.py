"""Website audits as Spark jobs: pages in, findings, scores and reports out."""
