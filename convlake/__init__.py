"""convlake: conversation, lead and request-log analytics as Spark jobs.

Sub-packages:
  functions  - Column expressions (regex redaction, extraction, classifiers)
  operators  - DataFrame-in / DataFrame-out jobs (history, limits, routing, ...)
  sources    - readers and writers (logs, leads, SSE text, knowledge files)
  plans      - fixture views and the query / oracle registry
  streaming  - Structured Streaming twins of the batch jobs
"""

__version__ = "0.1.0"
