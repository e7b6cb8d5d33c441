"""Assessment models: surplus production, age-structured and spatial dynamics, reference points."""
