"""Complete jobs: features, history, models, scores, risk, sentiment and serving reads."""
