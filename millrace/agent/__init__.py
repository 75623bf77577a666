"""Language-model search over pipelines: protocol, tree agent, baselines, evaluation."""
