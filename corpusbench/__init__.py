"""DataFrame operators for labelled-corpus curation, mixture sampling and detector evaluation."""
