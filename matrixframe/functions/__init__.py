"""Random numbers, feature maps, losses, preparation and scoring."""
