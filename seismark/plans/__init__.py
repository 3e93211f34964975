"""Learning and scoring plans over feature panels."""
