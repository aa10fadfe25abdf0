"""Nothing here works on unbounded input: events are completions of tasks (see plans.events), not event time."""
