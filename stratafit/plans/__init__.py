"""Model definitions, data objects, fitting, tuning and inference."""
