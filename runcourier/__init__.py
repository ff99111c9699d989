"""Run reports and alert delivery as set-at-a-time Spark jobs."""
